"""Training-data operators and the corpus pipeline's building blocks.

Nothing outside this folder imports it; ``__spark_entry__`` registers its
queries (``lodestar.llm.queries``) only when the folder is present.
"""
