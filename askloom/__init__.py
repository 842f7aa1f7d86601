"""Document retrieval, question answering and answer evaluation as Spark jobs."""

from askloom.session import local_session, materialize, shared_dir

__all__ = ["local_session", "materialize", "shared_dir"]
