"""tidemark: listing analytics as Spark DataFrame jobs.

Extraction, normalisation, taxonomy scoring, duplicate resolution, snapshot
reconciliation, curation, publishing, data quality and a faceted query layer,
each written as DataFrame-in / DataFrame-out functions.
"""

SCHEMA_VERSION = 1
