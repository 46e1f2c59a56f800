"""Document question answering as Spark jobs: ingest, chunk, embed, retrieve, answer, evaluate."""
