"""lodestar: Spark-native risk, disparity and complaint analytics.

Every operator is a lazy ``DataFrame -> DataFrame`` transformation. Driver-side
work is limited to small coefficient matrices, level lists and scalars.
"""

from lodestar.session import get_session, checkpoint_dir, scratch_path  # noqa: F401

__version__ = "0.1.0"
