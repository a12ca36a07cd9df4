"""The audit view over the driver tables, composed pipelines and the query registry."""
