"""Audits fibre-network design data and derives its bill of materials as Spark jobs."""
