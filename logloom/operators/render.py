"""Output layouts: canonical events to UDM, Wazuh JSON, OCSF JSON, CEF, LEEF, CSV, raw and custom lines, and syslog frames.

Every layout is a Column over the event struct, so rendering is a projection. Context (tenant, source, parser) comes from
columns of the frame when they exist.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import convert
from logloom.functions.columns import list_of, lookup, obj, template
from logloom.functions.convert import iso_ms
from logloom.plans.schema import CANONICAL, LEAVES

# fixed values of the output layouts
OCSF_VERSION = "1.3.0"
UDM_SEVERITY = {0: "UNKNOWN_SEVERITY", 1: "INFORMATIONAL", 2: "LOW", 3: "MEDIUM", 4: "HIGH", 5: "CRITICAL", 6: "CRITICAL"}
UDM_ACTION = {"Allowed": "ALLOW", "Blocked": "BLOCK", "Quarantined": "QUARANTINE", "Denied": "BLOCK", "Deleted": "BLOCK",
              "Isolated": "QUARANTINE", "Corrected": "ALLOW_WITH_MODIFICATION", "Detected": "UNKNOWN_ACTION"}
UDM_LOGON = {2: "INTERACTIVE", 3: "NETWORK", 4: "BATCH", 5: "SERVICE", 7: "UNLOCK", 8: "NETWORK_CLEAR_TEXT", 9: "NEW_CREDENTIALS",
             10: "REMOTE_INTERACTIVE", 11: "CACHED_INTERACTIVE"}
UDM_ACCOUNT = {1: "USER_CREATION", 3: "USER_CHANGE_PASSWORD", 4: "USER_CHANGE_PASSWORD", 6: "USER_DELETION"}
UDM_GROUP = {5: "GROUP_DELETION", 6: "GROUP_CREATION"}
UDM_PROCESS = {1: "PROCESS_LAUNCH", 2: "PROCESS_TERMINATION"}
UDM_FILE = {1: "FILE_CREATION", 2: "FILE_READ", 3: "FILE_MODIFICATION", 4: "FILE_DELETION"}
CEF_SEVERITY = {0: 0, 1: 1, 2: 3, 3: 5, 4: 8, 5: 10, 6: 10}
SYSLOG_SEVERITY = {0: 6, 1: 6, 2: 5, 3: 4, 4: 3, 5: 2, 6: 1}
CSV_COLUMNS = ("time", "tenant", "source", "class", "activity", "severity", "status", "disposition", "src_ip", "dst", "device", "user",
               "actor_user", "url", "file", "message")
EXTENSIONS = {"udm": "jsonl", "wazuh_json": "jsonl", "ocsf_json": "jsonl", "cef": "txt", "leef": "txt", "csv": "csv", "raw": "txt"}
APP = "logloom"


def _ctx(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _text(col: Column) -> Column:
    return col.cast("string")


# ---------------------------------------------------------------- UDM
def udm_event_type(e: Column) -> Column:
    """UDM event type by class and activity."""
    cls, act = e["class_uid"], e["activity_id"]
    by = lambda table, other: lookup(act, table, default=other)
    return (F.when(cls == 4002, "NETWORK_HTTP").when(cls == 4001, "NETWORK_CONNECTION").when(cls == 4003, "NETWORK_DNS")
            .when(cls == 3002, F.when(act == 2, "USER_LOGOUT").otherwise("USER_LOGIN"))
            .when(cls == 3001, by(UDM_ACCOUNT, "USER_UNCATEGORIZED")).when(cls == 3006, by(UDM_GROUP, "GROUP_MODIFICATION"))
            .when(cls == 1007, by(UDM_PROCESS, "PROCESS_UNCATEGORIZED")).when(cls == 1001, by(UDM_FILE, "FILE_UNCATEGORIZED"))
            .when(cls == 2004, F.when(e["malware"].isNotNull() | e["file"].isNotNull(), "SCAN_FILE").otherwise("STATUS_UPDATE"))
            .when(cls == 1008, "SYSTEM_AUDIT_LOG_UNCATEGORIZED").when(cls.isin(2001, 2002), "SCAN_VULN_HOST")
            .otherwise("GENERIC_EVENT"))


def _udm_user(u: Column) -> Column:
    sid = u["uid"].startswith("S-1-")
    return obj(userid=u["name"], windows_sid=F.when(sid, u["uid"]), product_object_id=F.when(~sid, u["uid"]),
               user_display_name=F.coalesce(u["display_name"], u["full_name"]), email_addresses=list_of(u["email_addr"]))


def _udm_file(f: Column, path: Column | None = None) -> Column:
    """File block; `path` stands in when the file itself is empty."""
    digest = lambda name: F.get(F.filter(f["hashes"], lambda h: F.upper(F.replace(h["algorithm"], F.lit("-"), F.lit(""))) == name), F.lit(0))["value"]
    full = f["path"]
    sig = F.when(f["signer"].isNotNull(), F.struct(F.struct(F.array(F.struct(f["signer"].alias("name"))).alias("signers")).alias("sigcheck")))
    size = _text(f["size"])
    if path is not None:
        others = F.coalesce(full, size, f["signer"], digest("SHA256"), digest("SHA1"), digest("MD5"))
        full = F.when(others.isNull(), path).otherwise(full)
    return obj(full_path=full, size=size, sha256=digest("SHA256"), sha1=digest("SHA1"), md5=digest("MD5"), signature_info=sig)


def _udm_process(p: Column) -> Column:
    return obj(pid=p["pid"], command_line=p["cmd_line"], file=_udm_file(p["file"], F.coalesce(p["path"], p["name"])))


def _head(text: Column, most: int | None) -> Column:
    """The first `most` characters, or the whole text."""
    return text if most is None else F.substring(text, 1, most)


def _extra_fields(e: Column, tenant: Column, key_max: int | None = None, text_max: int | None = None) -> Column:
    """Leftovers and a few secondary fields as one text map."""
    none = F.create_map().cast("map<string,string>")
    flat = convert.flatten_variant_map(e["unmapped"])
    kept = F.map_filter(flat, lambda _, v: v.isNotNull() & ~v.isin("", "-"))
    if key_max is not None:
        kept = F.transform_keys(kept, lambda k, _: _head(k, key_max))
    cut = F.transform_values(kept, lambda _, v: _head(v, text_max))
    side = {"policy.name": e["policy"]["name"], "policy.uid": e["policy"]["uid"], "device.org.name": e["device"]["org"]["name"],
            "device.logged_user": e["device"]["logged_user"], "status_code": e["status_code"],
            "metadata.parser_case": e["metadata"]["parser_case"], "metadata.event_subtype": e["metadata"]["event_subtype"],
            f"{APP}.tenant": tenant}
    named = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in side.items()]),
                                        lambda x: x["value"].isNotNull()))
    return F.map_concat(F.coalesce(cut, none), named)


def udm_columns(df: DataFrame, event: str = "event", prefix: str = "__udm_", key_max: int | None = None, text_max: int | None = None) -> DataFrame:
    """Adds the building blocks of the UDM record as columns, one projection per dependency level."""
    e = F.col(event)
    p = prefix
    src, dst, dev, md = e["src_endpoint"], e["dst_endpoint"], e["device"], e["metadata"]
    out = df.withColumns({
        f"{p}type": udm_event_type(e),
        f"{p}ips": F.coalesce(dev["ips"], list_of(dev["ip"])),
        f"{p}asset": F.when(dev["uid"].isNotNull(), F.concat(F.coalesce(md["product"]["vendor_name"], F.lit("device")), F.lit(":"), dev["uid"])),
        f"{p}actor": _udm_user(e["actor"]["user"]), f"{p}user": _udm_user(e["user"]),
        f"{p}actor_process": _udm_process(e["actor"]["process"]), f"{p}process": _udm_process(e["process"]),
        f"{p}file": _udm_file(e["file"]),
        f"{p}disp": F.coalesce(e["disposition"], e["action"]),
        f"{p}extra": _extra_fields(e, _ctx(df, "tenant"), key_max, text_max),
    })
    c = lambda name: F.col(f"{p}{name}")
    t = c("type")
    http = t == "NETWORK_HTTP"
    login = t.isin("USER_LOGIN", "USER_LOGOUT")
    account = ~login & (t.startswith("USER_") | t.startswith("GROUP_"))
    process = t.startswith("PROCESS_")
    scan = t == "SCAN_FILE"
    file = t.startswith("FILE_") | scan
    other = ~(http | login | account | process | file)
    local = src["ip"].isin("127.0.0.1", "::1", "0.0.0.0")
    remote = login & src["ip"].isNotNull() & ~local
    url = e["http_request"]["url"]
    src_ip, dst_ip = list_of(src["ip"]), list_of(dst["ip"])
    bare_http = http & src_ip.isNull()
    as_machine = account | process | file | other

    pick = lambda *pairs: F.coalesce(*[F.when(cond, value) for cond, value in pairs])
    domain = e["actor"]["user"]["domain"]
    out = out.withColumns({
        f"{p}principal": obj(
            hostname=pick((http, F.coalesce(src["hostname"], dev["hostname"])), (remote, src["hostname"]),
                          (other, F.coalesce(src["hostname"], dev["hostname"])), (as_machine, dev["hostname"])),
            ip=pick((bare_http, c("ips")), (http | remote, src_ip), (other, F.coalesce(src_ip, c("ips"))), (as_machine, c("ips"))),
            asset_id=F.when(http | as_machine, c("asset")),
            administrative_domain=F.when(bare_http | as_machine, domain),
            port=F.when(http | (remote & (src["port"] != 0)), src["port"]),
            user=F.when(remote | as_machine, c("actor")),
            process=F.when(remote | process | file, c("actor_process"))),
        f"{p}target": obj(
            hostname=pick((http, F.coalesce(url["hostname"], dst["hostname"])), (login | scan, dev["hostname"]), (other, dst["hostname"])),
            ip=pick((http | other, dst_ip), (login | scan, c("ips"))),
            asset_id=F.when(login | scan, c("asset")), administrative_domain=F.when(login | scan, domain),
            port=F.when(http, dst["port"]), url=F.when(http, url["url_string"]),
            user=F.when(login | account | other, c("user")),
            group=F.when(account, obj(group_display_name=e["group"]["name"], windows_sid=e["group"]["uid"])),
            process=F.when(process | other, c("process")), file=F.when(file | other, c("file"))),
        f"{p}network": F.when(http, F.struct(
            F.lit("TCP").alias("ip_protocol"),
            F.when((url["scheme"] == "https") | e["tls"].isNotNull(), "HTTPS").otherwise("HTTP").alias("application_protocol"),
            obj(method=e["http_request"]["http_method"], response_code=e["http_response"]["code"], user_agent=e["http_request"]["user_agent"],
                referral_url=e["http_request"]["referrer"]).alias("http"),
            _text(e["http_response"]["length"]).alias("received_bytes"),
            obj(version=e["tls"]["version"], cipher=e["tls"]["cipher"]).alias("tls"))),
        f"{p}security": obj(
            category=pick((login & (e["status"] == "Failure"), F.array(F.lit("AUTH_VIOLATION"))),
                          (file & e["malware"].isNotNull(), F.array(F.lit("SOFTWARE_MALICIOUS")))),
            action=pick((login & (e["status"] == "Failure"), F.array(F.lit("BLOCK"))), (login & (e["status"] == "Success"), F.array(F.lit("ALLOW"))),
                        (c("disp").isNotNull(), F.array(lookup(c("disp"), UDM_ACTION, default="UNKNOWN_ACTION")))),
            severity=F.when((e["severity_id"].isNotNull() & e["class_uid"].isin(2004, 3002, 3001, 3006, 1007, 2002)) | c("disp").isNotNull(),
                            lookup(e["severity_id"], UDM_SEVERITY, default="UNKNOWN_SEVERITY")),
            threat_name=F.when(file, F.get(e["malware"], F.lit(0))["name"]),
            category_details=F.when(http, url["categories"]),
            summary=F.coalesce(e["finding_info"]["title"], F.when(c("disp").isNotNull() | (e["class_uid"] == 2004), e["message"])),
            rule_name=F.coalesce(e["rule"]["name"], e["policy"]["name"]), rule_id=e["rule"]["uid"],
            description=F.coalesce(e["status_detail"], e["finding_info"]["desc"])),
        f"{p}auth": F.when(login, F.struct(F.struct(F.lit("MACHINE").alias("type"), F.array(
            lookup(e["logon_type_id"], UDM_LOGON, default="MECHANISM_OTHER")).alias("mechanism")).alias("auth"))),
    })
    pr, tg = c("principal"), c("target")
    placed = lambda s: s["hostname"].isNotNull() | s["ip"].isNotNull() | s["asset_id"].isNotNull()
    enough = (F.when(http, tg["url"].isNotNull() & (tg["hostname"].isNotNull() | tg["ip"].isNotNull()))
              .when(t == "NETWORK_CONNECTION", pr.isNotNull() & tg.isNotNull())
              .when(login, tg["user"].isNotNull() & (pr.isNotNull() | placed(tg)))
              .when(t.startswith("USER_"), tg["user"].isNotNull() & pr.isNotNull())
              .when(t.startswith("GROUP_"), pr.isNotNull() & tg.isNotNull())
              .when(process, pr.isNotNull() & tg["process"].isNotNull())
              .when(scan, tg["file"].isNotNull() & placed(tg))
              .when(file, pr.isNotNull() & tg["file"].isNotNull())
              .when(t.isin("STATUS_UPDATE", "SYSTEM_AUDIT_LOG_UNCATEGORIZED"), placed(pr)).otherwise(True))
    return out.withColumn(f"{p}enough", F.coalesce(enough, F.lit(False)))


def to_udm(df: DataFrame, event: str = "event", to: str = "udm", key_max: int | None = None, text_max: int | None = None,
           code_max: int | None = None) -> DataFrame:
    """Adds the UDM record as a struct. A record without the minimum its type needs becomes a GENERIC_EVENT that names
    its first type under `additional`. Leftover keys, leftover texts and event codes are whole unless a limit in characters is given."""
    e, md = F.col(event), F.col(event)["metadata"]
    out = udm_columns(df, event, key_max=key_max, text_max=text_max)
    c = lambda name: F.col(f"__udm_{name}")
    fallback = ~c("enough")
    extra = F.when(fallback, F.map_concat(c("extra"), F.create_map(F.lit(f"{APP}.udm_type_original"), c("type")))).otherwise(c("extra"))
    record = F.struct(
        F.struct(iso_ms(e["time"]).alias("event_timestamp"), F.when(fallback, "GENERIC_EVENT").otherwise(c("type")).alias("event_type"),
                 md["product"]["vendor_name"].alias("vendor_name"), md["product"]["name"].alias("product_name"),
                 md["product"]["version"].alias("product_version"), _head(md["event_code"], code_max).alias("product_event_type"),
                 md["uid"].alias("product_log_id"), e["message"].alias("description"),
                 iso_ms(md["logged_time"]).alias("collected_timestamp")).alias("metadata"),
        c("principal").alias("principal"), c("target").alias("target"), c("network").alias("network"), c("auth").alias("extensions"),
        F.when(c("security").isNotNull(), F.array(c("security"))).alias("security_result"),
        F.when(e["observer"]["hostname"].isNotNull(), F.struct(e["observer"]["hostname"].alias("hostname"))).alias("observer"),
        F.when(e["proxy_endpoint"]["ip"].isNotNull(), F.array(F.struct(F.array(e["proxy_endpoint"]["ip"]).alias("ip")))).alias("intermediary"),
        F.when(F.cardinality(extra) > 0, extra).alias("additional"))
    return out.withColumn(to, F.when(e.isNotNull(), record)).drop(*[x for x in out.columns if x.startswith("__udm_")])


def unparsed_line(raw: Column) -> Column:
    """Unrecognised line for sinks that take text."""
    return F.concat(F.lit(f"[{APP}:unparsed] "), raw)


# ---------------------------------------------------------------- OCSF and Wazuh
def _event_json_fields(e: Column, skip: Sequence[str] = ()) -> list[Column]:
    """Top-level fields of the event, times as ISO text with milliseconds."""
    def convert_node(col: Column, node) -> Column:
        if node == "timestamp":
            return iso_ms(col)
        if isinstance(node, Mapping) and _has_time(node):
            return F.when(col.isNotNull(), F.struct(*[convert_node(col[n], k).alias(n) for n, k in node.items()]))
        return col
    return [convert_node(e[n], k).alias(n) for n, k in CANONICAL.items() if n not in skip]


def _has_time(node) -> bool:
    return node == "timestamp" or (isinstance(node, Mapping) and any(_has_time(k) for k in node.values()))


def to_ocsf(e: Column, raw: Column | None = None) -> Column:
    """OCSF JSON text: the event with the schema version, and the raw line when given."""
    fields = _event_json_fields(e, skip=("metadata",))
    md = e["metadata"]
    meta = F.struct(*[(iso_ms(md[n]) if k == "timestamp" else md[n]).alias(n) for n, k in CANONICAL["metadata"].items()],
                    F.lit(OCSF_VERSION).alias("version"))
    extra = [F.when(raw != "", raw).alias("raw_data")] if raw is not None else []
    return F.to_json(F.struct(*fields, meta.alias("metadata"), *extra))


_DETAILS_SKIP = ("time", "message", "class_name", "class_uid", "severity", "severity_id", "status", "disposition", "activity_name")


def details_map(e: Column, most: int | None = None, key_max: int | None = None, text_max: int | None = None) -> Column:
    """The other fields of the event, flattened with '_' in the keys: all entries, keys and texts whole, unless limits are given."""
    entries, lists = [], []
    for path, kind in LEAVES.items():
        if path.split(".")[0] in _DETAILS_SKIP or kind.startswith("map"):
            continue
        col = e
        for step in path.split("."):
            col = col[step]
        key = F.lit(path.replace(".", "_")[:key_max])
        if kind == "array<string>":
            entries.append(F.struct(key.alias("key"), F.array_join(col, ", ").alias("value")))
        elif kind.startswith("array<struct"):
            lists.append(_numbered_entries(col, path.replace(".", "_"), re.findall(r"(\w+):string", kind)))
        else:
            entries.append(F.struct(key.alias("key"), (iso_ms(col) if kind == "timestamp" else _text(col)).alias("value")))
    fixed = F.filter(F.concat(F.array(*entries), *lists), lambda x: x["value"].isNotNull() & ~x["value"].isin("", "-"))
    left = F.transform(F.map_entries(convert.flatten_variant_map(e["unmapped"])), lambda x: F.struct(
        _head(F.concat(F.lit("unmapped_"), F.replace(x["key"], F.lit("."), F.lit("_"))), key_max).alias("key"), x["value"].alias("value")))
    both = F.concat(fixed, F.coalesce(F.filter(left, lambda x: x["value"].isNotNull() & ~x["value"].isin("", "-")),
                                      F.array().cast("array<struct<key:string,value:string>>")))
    cut = F.transform(both if most is None else F.slice(both, 1, most), lambda x: F.struct(x["key"], _head(x["value"], text_max)))
    return F.when(F.size(both) > 0, F.map_from_entries(cut))


def _numbered_entries(col: Column, prefix: str, names: Sequence[str]) -> Column:
    """(key, value) of every member of an array of structs, the position in the key."""
    def members(item: Column, i: Column) -> Column:
        key = lambda n: F.concat(F.lit(prefix + "_"), i.cast("string"), F.lit("_" + n))
        return F.array(*[F.struct(key(n).alias("key"), item[n].alias("value")) for n in names])
    return F.coalesce(F.flatten(F.transform(col, members)), F.array().cast("array<struct<key:string,value:string>>"))


def to_wazuh(df: DataFrame, e: Column) -> Column:
    """Wazuh JSON text: a few top-level aliases and one nested object with everything."""
    md, src, dst = e["metadata"], e["src_endpoint"], e["dst_endpoint"]
    actor = F.coalesce(e["actor"]["user"]["full_name"], e["actor"]["user"]["name"])
    url = e["http_request"]["url"]["url_string"]
    nested = dict(
        product=F.lit(APP), integration=F.lit(APP), tenant=_ctx(df, "tenant"), source=_ctx(df, "source"), parser=md["parser"],
        time=iso_ms(e["time"]), source_vendor=md["product"]["vendor_name"], source_product=md["product"]["name"], event_code=md["event_code"],
        class_uid=e["class_uid"], activity=e["activity_name"], severity=e["severity"], severity_id=e["severity_id"],
        status=e["status"], disposition=e["disposition"], message=e["message"], src_ip=src["ip"], src_port=src["port"], dst_ip=dst["ip"],
        dst_port=dst["port"], host=F.coalesce(e["device"]["hostname"], dst["hostname"]), actor_user=actor, target_user=e["user"]["name"], url=url,
        http_status=e["http_response"]["code"], file=F.coalesce(e["file"]["path"], e["process"]["file"]["path"]),
        rule=F.coalesce(e["rule"]["name"], e["policy"]["name"]), details=details_map(e))
    nested["class"] = e["class_name"]
    top = dict(srcip=src["ip"], dstip=dst["ip"], srcport=_text(src["port"]), dstport=_text(dst["port"]), srcuser=actor, dstuser=e["user"]["name"], url=url)
    return F.to_json(F.struct(*[v.alias(k) for k, v in top.items()], F.struct(*[v.alias(k) for k, v in nested.items()]).alias("ll")))


# ---------------------------------------------------------------- CEF, LEEF, CSV
def _epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts).cast("string")


def _pairs(pairs: Sequence[tuple[str, Column]], sep: str, clean: Callable[[Column], Column], joint: str = "=") -> Column:
    """`key=value` texts of the values that are not empty."""
    filled = lambda v: F.when(~_text(v).isin("", "-"), _text(v))
    parts = [F.concat(F.lit(k + joint), clean(filled(v))) for k, v in pairs]
    return F.concat_ws(sep, *parts)


def _header(*parts: Column, clean: Callable[[Column], Column]) -> Column:
    return F.concat_ws("|", *[clean(F.coalesce(_text(p), F.lit(""))) for p in parts])


def cef_header_text(v: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", " ")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return v


def cef_value_text(v: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("=", "\\="), ("\r", " "), ("\n", "\\n")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return v


def _severity10(e: Column) -> Column:
    return lookup(F.coalesce(e["severity_id"], F.lit(0)), CEF_SEVERITY, default=0)


def to_cef(df: DataFrame, e: Column) -> Column:
    md, src, dst = e["metadata"], e["src_endpoint"], e["dst_endpoint"]
    head = _header(F.lit("CEF:0"), F.coalesce(md["product"]["vendor_name"], F.lit("Unknown")), F.coalesce(md["product"]["name"], F.lit("Unknown")),
                   md["product"]["version"], F.coalesce(md["event_code"], F.when(e["class_uid"] != 0, _text(e["class_uid"])), F.lit("0")),
                   F.coalesce(e["activity_name"], e["class_name"], F.lit("Event")), _severity10(e), clean=cef_header_text)
    url = e["http_request"]["url"]
    kv = [("rt", _epoch_ms(e["time"])), ("src", src["ip"]), ("spt", src["port"]), ("shost", F.coalesce(src["hostname"], e["device"]["hostname"])),
          ("dst", dst["ip"]), ("dpt", dst["port"]), ("dhost", F.coalesce(dst["hostname"], url["hostname"])),
          ("suser", F.coalesce(e["actor"]["user"]["full_name"], e["actor"]["user"]["name"])), ("duser", e["user"]["name"]),
          ("act", F.coalesce(e["disposition"], e["action"])), ("outcome", e["status"]), ("request", url["url_string"]),
          ("requestMethod", e["http_request"]["http_method"]), ("requestClientApplication", e["http_request"]["user_agent"]),
          ("fname", F.coalesce(e["file"]["name"], e["process"]["file"]["name"])),
          ("filePath", F.coalesce(e["file"]["path"], e["process"]["file"]["path"])), ("sproc", e["actor"]["process"]["name"]),
          ("cat", e["class_name"]), ("msg", e["message"]), ("deviceExternalId", e["device"]["uid"]), ("dvchost", e["observer"]["hostname"])]
    custom = [("cs1", "tenant", _ctx(df, "tenant")), ("cs2", "policy", e["policy"]["name"]), ("cs3", "rule", e["rule"]["name"])]
    labelled = [F.concat(F.lit(f"{k}Label={name} {k}="), cef_value_text(F.when(~v.isin("", "-"), v))) for k, name, v in custom]
    ext = _pairs(kv, " ", cef_value_text)
    return F.concat(head, F.lit("|"), F.concat_ws(" ", F.when(ext != "", ext), *labelled))


def to_leef(df: DataFrame, e: Column) -> Column:
    md, src, dst = e["metadata"], e["src_endpoint"], e["dst_endpoint"]
    slash = lambda v: F.replace(v, F.lit("|"), F.lit("/"))
    head = _header(F.lit("LEEF:2.0"), F.coalesce(md["product"]["vendor_name"], F.lit("Unknown")), F.coalesce(md["product"]["name"], F.lit("Unknown")),
                   F.coalesce(md["product"]["version"], F.lit("1.0")),
                   F.coalesce(md["event_code"], F.when(e["class_uid"] != 0, _text(e["class_uid"])), F.lit("0")), F.lit("^"), clean=slash)
    url = e["http_request"]["url"]
    sev = lookup(F.coalesce(e["severity_id"], F.lit(0)), {k: v for k, v in CEF_SEVERITY.items() if k < 6}, default=0)
    kv = [("devTime", _epoch_ms(e["time"])), ("sev", sev), ("src", src["ip"]), ("srcPort", src["port"]), ("dst", dst["ip"]), ("dstPort", dst["port"]),
          ("usrName", F.coalesce(e["user"]["name"], e["actor"]["user"]["name"])), ("identSrc", src["ip"]), ("identHostName", e["device"]["hostname"]),
          ("action", F.coalesce(e["disposition"], e["action"])), ("cat", e["class_name"]), ("url", url["url_string"]),
          ("method", e["http_request"]["http_method"]), ("userAgent", e["http_request"]["user_agent"]), ("responseCode", e["http_response"]["code"]),
          ("dhost", F.coalesce(dst["hostname"], url["hostname"])), ("fileName", F.coalesce(e["file"]["name"], e["process"]["file"]["name"])),
          ("filePath", F.coalesce(e["file"]["path"], e["process"]["file"]["path"])), ("policy", e["policy"]["name"]), ("rule", e["rule"]["name"]),
          ("msg", e["message"]), ("tenant", _ctx(df, "tenant"))]
    flat = lambda v: F.translate(v, "^\n", "  ")
    return F.concat(head, F.lit("|"), _pairs(kv, "^", flat))


def csv_values(df: DataFrame, e: Column) -> list[Column]:
    actor = e["actor"]["user"]
    return [iso_ms(e["time"]), _ctx(df, "tenant"), _ctx(df, "source"), e["class_name"], e["activity_name"], e["severity"], e["status"],
            e["disposition"], e["src_endpoint"]["ip"], F.coalesce(e["dst_endpoint"]["hostname"], e["dst_endpoint"]["ip"]), e["device"]["hostname"],
            e["user"]["name"], F.coalesce(actor["full_name"], actor["name"]), e["http_request"]["url"]["url_string"],
            F.coalesce(e["file"]["path"], e["process"]["file"]["path"]), e["message"]]


def csv_text(v: Column, delimiter: str = ",") -> Column:
    """Field quoted only where the delimiter, a quote or a line break makes it necessary."""
    s = F.coalesce(_text(v), F.lit(""))
    special = s.rlike('["\r\n' + re.escape(delimiter) + "]")
    return F.when(special, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def to_csv_line(df: DataFrame, e: Column) -> Column:
    return F.concat_ws(",", *[csv_text(v) for v in csv_values(df, e)])


def csv_header() -> str:
    return ",".join(CSV_COLUMNS)


# ---------------------------------------------------------------- custom layouts
@dataclass(frozen=True)
class OutputFormat:
    """A layout of one's own: serializer json, kv, csv, template, cef or leef over named columns.

    `mapping` reads the event struct (and the frame, for context) and returns name -> Column; in JSON a dotted name nests.
    """
    slug: str
    serializer: str
    mapping: Callable[[DataFrame, Column], Mapping[str, Column]] = lambda df, e: {}
    template: str = ""
    header: Mapping[str, object] | None = None
    columns: Sequence[str] = ()
    delimiter: str = ","
    pair_sep: str = " "
    kv_sep: str = "="

    def __post_init__(self):
        if self.serializer not in ("json", "kv", "csv", "template", "cef", "leef"):
            raise ValueError(f"unknown serializer: {self.serializer}")


def _kv_text(v: Column) -> Column:
    return F.when(v.rlike(r'[\s"=]'), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)


def _nested_json(values: Mapping[str, Column]) -> Column:
    tree: dict = {}
    for path, col in values.items():
        node = tree
        *parents, leaf = path.split(".")
        for step in parents:
            node = node.setdefault(step, {})
        node[leaf] = col
    build = lambda node: obj(**{k: build(v) if isinstance(v, dict) else v for k, v in node.items()})
    return F.coalesce(F.to_json(build(tree)), F.lit("{}"))


def render_custom(df: DataFrame, fmt: OutputFormat, e: Column) -> Column:
    kept = lambda v: F.when(~_text(v).isin("", "-"), v) if not isinstance(v, str) else F.lit(v)
    if fmt.serializer == "template":
        def resolve(name: str) -> Column:
            if name.startswith("e."):
                col = e
                for step in name[2:].split("."):
                    col = col[step]
                return iso_ms(col) if LEAVES.get(name[2:]) == "timestamp" else _text(col)
            return _ctx(df, name.removeprefix("ctx."))
        return template(fmt.template, resolve)
    values = dict(fmt.mapping(df, e))
    if fmt.serializer == "json":
        return _nested_json(values)
    if fmt.serializer == "kv":
        return _pairs(list(values.items()), fmt.pair_sep, _kv_text, fmt.kv_sep)
    if fmt.serializer == "csv":
        names = fmt.columns or list(values)
        none = F.lit(None).cast("string")
        return F.concat_ws(fmt.delimiter, *[csv_text(kept(values[n]) if n in values else none, fmt.delimiter) for n in names])
    h = fmt.header or {}
    col = lambda name, other: F.coalesce(_text(h[name]), F.lit("0")) if isinstance(h.get(name), Column) else F.lit(str(h.get(name, other)))
    code = col("event_id", "") if "event_id" in h else F.coalesce(e["metadata"]["event_code"], F.lit("0"))
    if fmt.serializer == "cef":
        name = col("name", "") if "name" in h else F.coalesce(e["class_name"], F.lit("Event"))
        head = _header(F.lit("CEF:0"), F.lit(h.get("vendor", "")), F.lit(h.get("product", "")), F.lit(h.get("version", "")), code, name,
                       col("severity", "0"), clean=cef_header_text)
        return F.concat(head, F.lit("|"), _pairs(list(values.items()), " ", cef_value_text))
    head = _header(F.lit("LEEF:2.0"), F.lit(h.get("vendor", "")), F.lit(h.get("product", "")), F.lit(h.get("version", "1.0")), code, F.lit("^"),
                   clean=lambda v: v)
    return F.concat(head, F.lit("|"), _pairs(list(values.items()), "^", lambda v: v))


# ---------------------------------------------------------------- choice of layout and framing
def render_rows(df: DataFrame, formats: Sequence[str], fmt: Column, event: str = "event", raw: str = "raw", to: str = "value",
                custom: Sequence[OutputFormat] = ()) -> DataFrame:
    """Adds the rendered line; `fmt` names the layout of each row. Only the listed layouts are compiled into the plan.

    Unparsed rows give a generic UDM record for `udm`, the line itself for `raw`, and a tagged line otherwise.
    """
    own = {f.slug: f for f in custom}
    unknown = [f for f in formats if f not in EXTENSIONS and f not in own]
    if unknown:
        raise ValueError(f"unknown layouts: {unknown}")
    e, failed = F.col(event), F.col("status") != "parsed"
    frame = to_udm(df, event, "__udm") if "udm" in formats else df
    choice = F.when(fmt == "raw", F.col(raw))
    for name in formats:
        if name == "raw":
            continue
        value = {
            "udm": lambda: F.to_json(F.col("__udm")), "ocsf_json": lambda: to_ocsf(e), "wazuh_json": lambda: to_wazuh(df, e),
            "cef": lambda: to_cef(df, e), "leef": lambda: to_leef(df, e), "csv": lambda: to_csv_line(df, e),
        }.get(name, lambda: render_custom(df, own[name], e))()
        if name == "udm":
            value = F.when(failed, generic_udm_line(df, raw)).otherwise(value)
        choice = choice.when((fmt == name) if name == "udm" else (fmt == name) & ~failed, value)
    out = frame.withColumn(to, choice.otherwise(unparsed_line(F.col(raw))))
    return out.drop("__udm") if "udm" in formats else out


def generic_udm_line(df: DataFrame, raw: str = "raw", text_max: int | None = None) -> Column:
    """UDM text of a line that was not recognised; the line and its error are whole unless a limit in characters is given."""
    when = F.col("received_at") if "received_at" in df.columns else F.lit(None).cast("timestamp")
    extra = F.map_filter(F.create_map(
        F.lit("raw"), _head(F.col(raw), text_max), F.lit("error"), _head(F.col("error"), text_max), F.lit(f"{APP}.tenant"), _ctx(df, "tenant")),
        lambda _, v: v.isNotNull() & ~v.isin("", "-"))
    return F.to_json(F.struct(
        F.struct(iso_ms(when).alias("event_timestamp"), F.lit("GENERIC_EVENT").alias("event_type"), F.lit(APP).alias("vendor_name"),
                 F.lit(APP).alias("product_name"), F.lit("unparsed").alias("product_event_type"),
                 F.lit("line not recognised").alias("description")).alias("metadata"),
        F.struct(F.coalesce(_ctx(df, "peer_ip"), F.lit(APP)).alias("hostname")).alias("observer"), extra.alias("additional")))


def render(fmt: str, df: DataFrame, e: Column, raw: Column) -> Column:
    """One built-in text layout as a Column (UDM needs a frame, see `render_rows`)."""
    return {"ocsf_json": lambda: to_ocsf(e), "wazuh_json": lambda: to_wazuh(df, e), "cef": lambda: to_cef(df, e), "leef": lambda: to_leef(df, e),
            "csv": lambda: to_csv_line(df, e), "raw": lambda: raw}[fmt]()


def syslog_frame(payload: Column, at: Column, header: Column | str = "rfc3164", facility: Column | int = 1, severity_id: Column | int = 0,
                 host: str = APP, app: str = APP) -> Column:
    """Payload behind an RFC 3164 or RFC 5424 header; line breaks in it become spaces."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    sev = lookup(F.coalesce(lit(severity_id), F.lit(0)), SYSLOG_SEVERITY, default=6)
    pri = F.concat(F.lit("<"), (lit(facility) * 8 + sev).cast("string"), F.lit(">"))
    body = F.translate(payload, "\n\r", "  ")
    host = host.replace(" ", "_")
    modern = F.concat(pri, F.lit("1 "), iso_ms(at), F.lit(f" {host} {app} - - - "), body)
    day = F.lpad(F.dayofmonth(at).cast("string"), 2, " ")
    old = F.concat(pri, F.date_format(at, "MMM"), F.lit(" "), day, F.lit(" "), F.date_format(at, "HH:mm:ss"), F.lit(f" {host} {app}: "), body)
    return F.when(lit(header) == "rfc5424", modern).otherwise(old)
