"""airloom: sensor analytics and hybrid retrieval, written as Spark plans."""
