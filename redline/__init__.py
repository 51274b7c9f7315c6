"""redline: Spark-native data engine for grammatical-error-correction corpora.

Subpackages
-----------
functions  column expressions (tokenising, cleaning, prompts, fixed-length arrays)
sources    readers / writers and the derived ``gec_pairs`` fixture
operators  table operators: corpus, split, align, edits, vocab, metrics,
           encode, tagger, scoring, runs
plans      session set-up and end-to-end jobs
streaming  the row-wise corpus operators on ``readStream``
"""

__version__ = "0.1.0"
