"""pagemill: Spark operators for page corpora (inventories, ledgers, page text, audits, assembly)."""

__all__ = ["session", "tables"]
