"""lakeloom: versioned data transformation on Spark."""

from .errors import AuditError, BlockedError, ContractError, EngineError, GraphError, LockError, LoomError, ModelError, ReclassifyError, StateError, UnavailableError
from .operators.audits import accepted, assert_contiguous, assert_no_gaps, custom, not_null, unique
from .plans.config import Config, open_project
from .plans.engine import session
from .plans.graph import build_graph
from .plans.model import Compaction, Embedded, Full, Model, ScdType2, TimeRange, UniqueKey, View, csv, external, json, model, parquet, seed, sql_model, table
from .plans.project import Project
from .plans.state import StateStore, migrate
from .sources.lake import read_manifest
from .testing import check_model

__all__ = [
    "AuditError", "BlockedError", "Compaction", "Config", "ContractError", "Embedded", "EngineError", "Full", "GraphError", "LockError", "LoomError", "Model", "ModelError", "Project",
    "ReclassifyError", "ScdType2", "StateError", "StateStore", "TimeRange", "UnavailableError", "UniqueKey", "View", "accepted", "assert_contiguous", "assert_no_gaps", "build_graph",
    "check_model", "csv", "custom", "external", "json", "migrate", "model", "not_null", "open_project", "parquet", "read_manifest", "seed", "session", "sql_model", "table", "unique",
]
