"""Provenance of columns, procedures and user-interface actions, as Spark jobs."""
