"""docfacts: business documents to audited relational facts, on PySpark."""
