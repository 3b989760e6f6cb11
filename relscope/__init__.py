"""relscope: batch inference over argument pairs and classifier evaluation on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions; the only Python-worker steps are the model call, the
Arrow stream reader and two tail-probability helpers on result-sized frames.
"""

from relscope.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
