"""The canonical event: one fixed nested schema, an OCSF 1.3 subset, and helpers to take it apart and build it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.emptiness import present

_USER = {"name": "string", "domain": "string", "uid": "string", "full_name": "string", "display_name": "string", "email_addr": "string"}
_HASHES = "array<struct<algorithm:string,value:string>>"
_FILE = {"name": "string", "path": "string", "size": "bigint", "hashes": _HASHES, "signer": "string",
         "created_time": "timestamp", "modified_time": "timestamp"}
_PROCESS = {"name": "string", "path": "string", "pid": "string", "cmd_line": "string",
            "file": {"name": "string", "path": "string", "size": "bigint", "hashes": _HASHES, "signer": "string"}}
_ENDPOINT = {"ip": "string", "port": "int", "hostname": "string"}
_NAMED = {"name": "string", "uid": "string"}

# fixed values: field names and types of the canonical event
CANONICAL: dict = {
    "time": "timestamp", "class_uid": "int", "class_name": "string", "category_uid": "int", "category_name": "string",
    "activity_id": "int", "activity_name": "string", "type_uid": "int", "severity_id": "int", "severity": "string",
    "status": "string", "status_id": "int", "status_code": "string", "status_detail": "string",
    "disposition": "string", "disposition_id": "int", "action": "string", "action_id": "int", "message": "string",
    "metadata": {"product": {"vendor_name": "string", "name": "string", "version": "string"}, "event_code": "string",
                 "event_subtype": "string", "log_name": "string", "uid": "string", "logged_time": "timestamp",
                 "parser": "string", "parser_case": "string"},
    "src_endpoint": _ENDPOINT, "dst_endpoint": _ENDPOINT, "proxy_endpoint": {"ip": "string"},
    "device": {"hostname": "string", "uid": "string", "ip": "string", "ips": "array<string>", "domain": "string", "os": "string",
               "org": {"name": "string"}, "logged_user": "string"},
    "actor": {"user": _USER, "process": _PROCESS},
    "user": _USER, "group": {"name": "string", "domain": "string", "uid": "string"}, "process": _PROCESS, "file": _FILE,
    "http_request": {"http_method": "string", "version": "string", "user_agent": "string", "referrer": "string",
                     "x_forwarded_for": "array<string>",
                     "url": {"url_string": "string", "scheme": "string", "hostname": "string", "port": "int", "path": "string",
                             "query_string": "string", "categories": "array<string>"}},
    "http_response": {"code": "int", "length": "bigint"}, "tls": {"version": "string", "cipher": "string"},
    "connection_info": {"protocol_name": "string", "direction": "string"},
    "traffic": {"bytes_in": "bigint", "bytes_out": "bigint", "packets_in": "bigint", "packets_out": "bigint"},
    "finding_info": {"title": "string", "uid": "string", "desc": "string", "types": "array<string>"},
    "malware": "array<struct<name:string,classification:string>>",
    "vulnerabilities": "array<struct<cve:string,severity:string,title:string>>",
    "policy": {**_NAMED, "version": "string"}, "rule": {**_NAMED, "type": "string"}, "observer": {"hostname": "string"},
    "logon_type_id": "int", "auth_protocol": "string", "logon_process": {"name": "string"},
    "unmapped": "map<string,variant>",
}


def leaves(tree: Mapping = CANONICAL, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, type) of every leaf."""
    for name, kind in tree.items():
        path = f"{prefix}.{name}" if prefix else name
        if isinstance(kind, Mapping):
            yield from leaves(kind, path)
        else:
            yield path, kind


LEAVES = dict(leaves())


def ddl(tree: Mapping = CANONICAL) -> str:
    return "struct<" + ",".join(f"{n}:{ddl(k) if isinstance(k, Mapping) else k}" for n, k in tree.items()) + ">"


CANONICAL_DDL = ddl()


def subtree(path: str):
    node = CANONICAL
    for step in path.split("."):
        if not isinstance(node, Mapping) or step not in node:
            raise ValueError(f"{path} is not a canonical field")
        node = node[step]
    return node


def leaf_paths(path: str) -> list[str]:
    """Leaves at or below a canonical path."""
    node = subtree(path)
    return [p for p, _ in leaves(node, path)] if isinstance(node, Mapping) else [path]


def typed(path: str, col: Column) -> Column:
    """Value cast to the type of its canonical leaf, NULL when empty."""
    kind = LEAVES[path]
    if kind == "string":
        return present(col.cast("string"))
    if kind in ("int", "bigint"):
        return col.try_cast(kind)
    if kind.startswith("array"):
        return F.when(F.size(col) > 0, col.cast(kind))
    if kind.startswith("map"):
        return F.when(F.cardinality(col) > 0, col)
    return col.cast(kind)


def assemble(names: Mapping[str, str]) -> Column:
    """Nested event struct from columns holding its leaves (path -> column name).

    A struct without any value is NULL at every level. The expression is handed over as one SQL text: built call by call
    it would take hundreds of round trips to the JVM.
    """
    return F.expr(_struct_sql(names, CANONICAL, ""))


def _struct_sql(names: Mapping[str, str], tree: Mapping, prefix: str) -> str:
    fields, known = [], []
    for name, kind in tree.items():
        path = f"{prefix}.{name}" if prefix else name
        if isinstance(kind, Mapping):
            below = [names[p] for p, _ in leaves(kind, path) if p in names]
            value = _struct_sql(names, kind, path) if below else f"cast(null as {ddl(kind)})"
        else:
            below = [names[path]] if path in names else []
            value = f"`{names[path]}`" if below else f"cast(null as {kind})"
        known += below
        fields.append(f"'{name}', {value}")
    struct = f"named_struct({', '.join(fields)})"
    if not prefix:
        return struct
    return f"case when {' or '.join(f'`{k}` is not null' for k in known)} then {struct} end"
