"""palimpsest: document-edit analytics and corpus preparation on Apache Spark."""
