from breathline.sources import files, schemas, tables

__all__ = ["files", "schemas", "tables"]
