"""A query engine for genomic records on Apache Spark."""
