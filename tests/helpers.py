"""Small builders for test tables."""

COLUMN_SCHEMA = (
    "run_key string, relation string, column_name string, data_type string, nullable boolean, "
    "ordinal int, expression string"
)
CHANGE_SCHEMA = (
    "run_key string, change_id string, relation string, change_type string, old_column string, new_column string, "
    "old_type string, new_type string, old_nullable boolean, new_nullable boolean, evidence_refs array<string>, "
    "source_path string, confidence string"
)
ASSET_SCHEMA = (
    "run_key string, urn string, asset_type string, name string, hop_count int, owners array<string>, "
    "assertion_urns array<string>, critical_asset boolean, sensitive_data boolean, direct_column_lineage boolean, "
    "recent_query_usage_score int"
)
STATE_SCHEMA = "run_key string, catalog string, lineage string, traversal string, ownership string, assertions string"
COMPLETE = ("complete",) * 5


def change(run="r", cid="c1", kind="rename_column", **kw):
    fields = dict(
        relation="t", old_column="a", new_column="b", old_type=None, new_type=None, old_nullable=None,
        new_nullable=None, evidence_refs=[], source_path="p", confidence="high",
    )
    fields.update(kw)
    return (
        run, cid, fields["relation"], kind, fields["old_column"], fields["new_column"], fields["old_type"],
        fields["new_type"], fields["old_nullable"], fields["new_nullable"], fields["evidence_refs"],
        fields["source_path"], fields["confidence"],
    )


def asset(run="r", urn="u1", kind="dataset", hop=1, owners=("o",), assertions=(), critical=False,
          sensitive=False, direct=False, usage=None, name=None):
    as_list = lambda v: None if v is None else list(v)
    return (run, urn, kind, name, hop, as_list(owners), as_list(assertions), critical, sensitive, direct, usage)


def collect(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
