"""Training-data operators: ten Spark operators over a corpus of documents, pages and recordings.

Nothing outside this folder but ``corpus_pipeline.py`` and the driver's entry
imports it. Every operator takes DataFrames and returns a DataFrame;
``queries.py`` applies each to its whole table.
"""
