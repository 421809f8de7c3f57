"""nearpass: close-encounter analytics as lazy Spark DataFrame operators."""

from nearpass.session import build_session, checkpoint_root, stage, table

__all__ = ["build_session", "checkpoint_root", "stage", "table"]
