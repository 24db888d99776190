"""The rule registry and whole audits."""
