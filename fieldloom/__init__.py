"""Fieldloom: multi-source record indexing and field search on Spark DataFrames."""

from fieldloom.catalog import Catalog, FieldSpec
from fieldloom.session import build_session, shared_dir

__all__ = ["Catalog", "FieldSpec", "build_session", "shared_dir"]
