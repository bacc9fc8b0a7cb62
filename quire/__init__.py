"""quire: analytics over document corpora, written as Spark plans."""
