"""The data model: enumerations, table schemas, ids and symbol keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model. The order of kinds is their rank in ties.
SCOPES = ("production", "test", "fixture", "example", "generated", "vendor", "docs")
KINDS = (
    "function", "method", "struct", "class", "enum", "variant", "trait", "interface", "typealias", "constant", "static", "variable", "field", "module", "macro", "file", "section",
)
RELATIONS = ("calls", "uses", "imports", "contains", "implements", "extends")
EVIDENCE = ("structural", "scope", "import", "scip", "declared", "dynamic")
CERTAIN = ("structural", "scip", "declared")
REASONS = ("syntax_anchored_miss", "syntax_only", "compiler_unresolved")
CATEGORIES = ("likely_external", "missing_compiler_index", "missing_receiver_type", "ambiguous_internal_target", "unsupported_syntax", "actionable_anchored_miss")
TYPE_KINDS = ("struct", "enum", "interface", "trait", "typealias")
MEMBER_SCOPES = (*TYPE_KINDS, "class")
CALLABLE_KINDS = ("function", "method", "macro", "class")

NODES = "id string, kind string, name string, file string, start bigint, end bigint, signature string, doc string"
EDGES = "src string, dst string, relation string, evidence string, confidence string, site_start bigint, site_end bigint"
REFS = "ref_id bigint, file string, name string, path string, relation string, start bigint, end bigint, enclosing string, alias string"
LOCALS = "file string, name string, start bigint, end bigint, scope_end bigint, type_name string"
FIELDS = "owner string, name string, type_name string"
EMBEDS = "owner string, type_name string"
TRAIT_IMPLS = "file string, trait_name string, start bigint, end bigint"
STAMPS = "file string, hash string, identity string, len bigint"
LINKS = "src_member string, src_id string, dst_member string, dst_id string, relation string, evidence string, confidence string, via string"
SCHEMA_VERSION = 1


def kind_rank(kind: Column) -> Column:
    """The ordinal of a kind."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1


def confidence(evidence: Column) -> Column:
    """Certain or inferred, as the evidence alone decides."""
    return F.when(evidence.isin(*CERTAIN), "certain").otherwise("inferred")


def qualified(node_id: Column) -> Column:
    """What stands between the first # and the last @; empty for a file's id."""
    return F.regexp_extract(node_id, r"^[^#]*#(.*)@[^@]*$", 1)


def symbol_key(kind: Column, file: Column, node_id: Column) -> Column:
    """A handle without offsets: symbol:kind:byte length of the file:file#qualified."""
    return F.concat(F.lit("symbol:"), kind, F.lit(":"), F.octet_length(file).cast("string"), F.lit(":"), file, F.lit("#"), qualified(node_id))


def is_type(kind: Column) -> Column:
    return kind.isin(*TYPE_KINDS)


def is_callable(kind: Column) -> Column:
    return kind.isin(*CALLABLE_KINDS)
