"""Training-data operators: ten distributed corpus jobs over ordinary DataFrames.

Each module holds one operator.  Nothing outside this folder and
``corpus_pipeline.py`` imports it.
"""
