"""From extracted blocks to the canonical event: mapping, conditional cases, leftovers, derived fields, required fields."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import convert
from logloom.functions.columns import lookup
from logloom.functions.emptiness import kept_members, present, present_map
from logloom.operators.extract import ERROR, with_error
from logloom.plans.schema import LEAVES, assemble, leaf_paths, subtree, typed


# fixed values: severity numbers by name, and names by number
SEVERITY_IDS = {"unknown": 0, "informational": 1, "info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5, "fatal": 6}
SEVERITY_NAMES = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical", 6: "Fatal"}


@dataclass(frozen=True)
class Timed:
    """A time for a mapping: a non-empty text that cannot be read fails the whole line."""
    source: Column
    value: Column

    @classmethod
    def auto(cls, source: Column) -> "Timed":
        return cls(source, convert.to_time(source))

    @classmethod
    def by_pattern(cls, source: Column, fmt: str) -> "Timed":
        return cls(source, convert.strptime(source, fmt))

    @property
    def problem(self) -> Column:
        bad = self.source.isNotNull() & ~self.source.isin("", "-") & self.value.isNull()
        return F.when(bad, F.concat(F.lit("unreadable time: "), self.source))


@dataclass(frozen=True)
class Spread:
    """A struct column for a whole object of the event: its named members go to the fields of the same name."""
    struct: Column
    members: Sequence[str]


Mapped = Mapping[str, "Column | Timed | Spread"]


@dataclass(frozen=True)
class Case:
    """Extra mapping laid over the base where `when` holds; the first match ends the search unless `go_on`."""
    name: str
    when: Column
    mapping: Mapped
    unset: Sequence[str] = ()
    go_on: bool = False


def _expand(mapping: Mapped) -> tuple[dict[str, Column], list[Column]]:
    """Mapping -> typed leaf columns and the time problems."""
    out: dict[str, Column] = {}
    problems: list[Column] = []
    for path, value in mapping.items():
        if isinstance(value, Spread):
            out.update({f"{path}.{m}": typed(f"{path}.{m}", value.struct[m]) for m in value.members})
            continue
        if isinstance(value, Timed):
            problems.append(value.problem)
            value = value.value
        if isinstance(subtree(path), Mapping):
            raise ValueError(f"{path} is an object: map its members, or use Spread")
        out[path] = typed(path, value)
    return out, problems


def _overlay(base: dict[str, Column], cases: Sequence[Case], flags: Sequence[Column]) -> tuple[dict[str, Column], Column, list[Column]]:
    """Final value per leaf: the last active case with a value wins, `unset` hides what came before it."""
    expanded = [_expand(c.mapping) for c in cases]
    hidden = [{leaf for path in c.unset for leaf in leaf_paths(path)} for c in cases]
    targets = dict.fromkeys([*base, *(leaf for m, _ in expanded for leaf in m)])
    values = {}
    for leaf in targets:
        current = [base[leaf]] if leaf in base else []
        for case, flag, (mapped, _), unset in zip(cases, flags, expanded, hidden):
            if leaf in unset and current:
                current = [F.when(~flag, F.coalesce(*current))]
            if leaf in mapped:
                current = [F.when(flag, mapped[leaf]), *current]
        values[leaf] = F.coalesce(*current) if len(current) > 1 else current[0]
    name = F.coalesce(*[F.when(flag, F.lit(case.name)) for case, flag in reversed(list(zip(cases, flags)))]) if cases else None
    problems = [F.when(flag, p) for flag, (_, found) in zip(flags, expanded) for p in found]
    return values, name, problems


def _active(df: DataFrame, cases: Sequence[Case]) -> tuple[DataFrame, list[Column]]:
    """One boolean column per case: its condition holds and no earlier case without `go_on` matched."""
    raw = {f"__when_{i}": F.coalesce(c.when, F.lit(False)) for i, c in enumerate(cases)}
    out = df.withColumns(raw) if raw else df
    flags = []
    for i in range(len(cases)):
        flag = F.col(f"__when_{i}")
        for j in range(i):
            if not cases[j].go_on:
                flag = flag & ~F.col(f"__when_{j}")
        flags.append(flag)
    return out, flags


def _build(df: DataFrame, base: dict[str, Column], problems: list[Column], cases: Sequence[Case], to: str,
           derive: bool = False, required: Sequence[str] = ()) -> DataFrame:
    out, flags = _active(with_error(df), cases)
    values, name, more = _overlay(base, cases, flags)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (ERROR, to)]
    if name is not None:
        values["metadata.parser_case"] = F.coalesce(name, values.get("metadata.parser_case", F.lit(None).cast("string")))
    # leaves first, struct second: each leaf is computed once although the struct tests it for NULL
    cols = {leaf: f"__leaf_{i}" for i, leaf in enumerate(values)}
    flat = out.select(*kept, F.coalesce(F.col(ERROR), *problems, *more).alias(ERROR), *[v.alias(cols[leaf]) for leaf, v in values.items()])
    if derive:
        absent = lambda leaf: F.col(cols[leaf]) if leaf in cols else F.lit(None).cast(LEAVES[leaf])
        flat = flat.withColumn("__sid", severity_id_of(absent("severity"), absent("severity_id")))
        flat = flat.withColumns({"__sev": severity_name_of(absent("severity"), F.col("__sid")),
                                 "__type": F.coalesce(absent("type_uid"), absent("class_uid") * 100 + absent("activity_id"))})
        cols.update({"severity": "__sev", "severity_id": "__sid", "type_uid": "__type"})
    missing = [F.when(F.col(cols[p]).isNull() if p in cols else F.lit(True), F.lit(f"required field missing: {p}")) for p in required]
    return flat.select(*kept, F.coalesce(F.col(ERROR), *missing).alias(ERROR), assemble(cols).alias(to))


def normalize(df: DataFrame, mapping: Mapped, cases: Sequence[Case] = (), to: str = "event", derive: bool = False,
              required: Sequence[str] = ()) -> DataFrame:
    """Canonical event from a mapping of dotted target paths to columns. Empty values are never written.

    `derive` also fills severity and type number, `required` reports the first missing field as the error.
    """
    base, problems = _expand(mapping)
    return _build(df, base, problems, cases, to, derive, required)


def apply_cases(df: DataFrame, cases: Sequence[Case], event: str = "event") -> DataFrame:
    """Lay conditional mappings over an event that exists already."""
    base = {leaf: F.col(f"{event}.{leaf}") for leaf in LEAVES}
    return _build(df, base, [], cases, event)


# ---------------------------------------------------------------- leftovers
def block_entries(col: Column, kind: T.DataType) -> Column:
    """Any extracted block as MAP<STRING, VARIANT> without its empty values."""
    if isinstance(kind, T.VariantType):
        return kept_members(F.try_variant_get(col, "$", "map<string,variant>"))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.VariantType):
            return kept_members(col)
        return F.transform_values(F.map_filter(col, lambda _, v: v.isNotNull() & ~v.isin("", "-")), lambda _, v: v.cast("variant"))
    members = [F.struct(F.lit(f.name).alias("key"), _as_variant(col[f.name], f.dataType).alias("value")) for f in kind.fields]
    return F.when(col.isNotNull(), F.map_from_entries(F.filter(F.array(*members), lambda e: e["value"].isNotNull())))


def _as_variant(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return present(col).cast("variant")
    if isinstance(kind, T.MapType):
        return F.when(F.cardinality(col) > 0, F.try_parse_json(F.to_json(col)))
    if isinstance(kind, T.StructType):
        return F.try_parse_json(F.to_json(col))
    return F.when(F.size(col) > 0, col).cast("variant") if isinstance(kind, T.ArrayType) else col.cast("variant")


def collect_unmapped(df: DataFrame, blocks: Sequence[str], drop: Sequence[str] = (), to: str = "unmapped") -> DataFrame:
    """Everything the blocks hold without the listed keys. The later block wins, but an empty value hides nothing."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    none = F.create_map().cast("map<string,variant>")
    maps = []
    for path in blocks:
        head, *rest = path.split(".")
        kind = kinds[head]
        for step in rest:
            kind = kind[step].dataType
        maps.append(F.coalesce(block_entries(F.col(path), kind), none))
    both = F.map_concat(*maps) if len(maps) > 1 else maps[0]
    if drop:
        both = F.map_filter(both, lambda k, _: ~k.isin(*drop))
    return df.withColumn(to, present_map(both))


# ---------------------------------------------------------------- derived fields
def severity_id_of(severity: Column, severity_id: Column) -> Column:
    named = F.coalesce(lookup(F.lower(severity), SEVERITY_IDS), F.lit(0))
    return F.coalesce(severity_id, F.when(severity.isNotNull(), named))


def severity_name_of(severity: Column, severity_id: Column) -> Column:
    return F.when(severity_id.isNotNull(), lookup(severity_id, SEVERITY_NAMES, default="Unknown")).otherwise(severity)


def derive_severity(df: DataFrame, event: str = "event") -> DataFrame:
    """Number from name (unknown name: 0), then name from number."""
    e = F.col(event)
    with_id = df.withColumn("__sid", severity_id_of(e["severity"], e["severity_id"]))
    return with_id.withColumn(event, e.withField("severity_id", F.col("__sid")).withField(
        "severity", severity_name_of(e["severity"], F.col("__sid")))).drop("__sid")


def derive_type_uid(df: DataFrame, event: str = "event") -> DataFrame:
    e = F.col(event)
    return df.withColumn(event, e.withField("type_uid", F.coalesce(e["type_uid"], e["class_uid"] * 100 + e["activity_id"])))


def require(df: DataFrame, paths: Sequence[str] = ("time",), event: str = "event") -> DataFrame:
    """The first required field that is missing becomes the error."""
    missing = [F.when(F.col(f"{event}.{p}").isNull(), F.lit(f"required field missing: {p}")) for p in paths]
    return with_error(df).withColumn(ERROR, F.coalesce(F.col(ERROR), *missing))


def precheck_error(raw: Column, max_bytes: int | None = None) -> Column:
    """Why a line cannot be parsed at all: missing, blank or, where a limit is given, above it."""
    empty = F.when(raw.isNull() | (convert.strip(raw) == ""), "empty line")
    return empty if max_bytes is None else empty.when(F.octet_length(raw) > max_bytes, f"line above the limit of {max_bytes} bytes")


def precheck(df: DataFrame, raw: str = "raw", max_bytes: int | None = None) -> DataFrame:
    return with_error(df).withColumn(ERROR, F.coalesce(F.col(ERROR), precheck_error(F.col(raw), max_bytes)))


def finish_status(df: DataFrame) -> DataFrame:
    """`parsed` or `unparsed`, and the error ('' when parsed)."""
    return df.withColumns({"status": F.when(F.col(ERROR).isNull(), "parsed").otherwise("unparsed"),
                           ERROR: F.coalesce(F.col(ERROR), F.lit(""))})


# ---------------------------------------------------------------- formats and dispatch
@dataclass(frozen=True)
class LogFormat:
    """One input format. `detect` reads the raw column only; `extract` adds blocks; the rest maps them to the event."""
    slug: str
    detect: Callable[[Column], Column]
    extract: Callable[[DataFrame, Column], DataFrame]
    mapping: Callable[[], Mapped]
    cases: Callable[[], Sequence[Case]] = tuple
    unmapped: Sequence[str] = ()
    unmapped_drop: Sequence[str] = ()
    required: Sequence[str] = ("time",)
    priority: int = 100
    active: bool = True

    def __post_init__(self):
        if not self.slug:
            raise ValueError("a format needs a slug")
        for path in self.required:
            subtree(path)


def in_order(formats: Sequence[LogFormat]) -> list[LogFormat]:
    slugs = [f.slug for f in formats]
    if len(set(slugs)) != len(slugs):
        raise ValueError("format slugs must be unique")
    return sorted((f for f in formats if f.active), key=lambda f: (f.priority, f.slug))


def detect_format(df: DataFrame, formats: Sequence[LogFormat], raw: str = "raw", to: str = "candidates") -> DataFrame:
    """Slugs of every active format that recognises the line, in order of trial."""
    tests = [F.when(F.coalesce(f.detect(F.col(raw)), F.lit(False)), F.lit(f.slug)) for f in in_order(formats)]
    return df.withColumn(to, F.filter(F.array(*tests), lambda x: x.isNotNull()))


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """The same frame with the named columns computed at this point of the plan.

    A one-row generator is a step no filter on these columns moves across, so a later condition on the parse result is
    tested on the result instead of being rewritten into every expression that led to it. Nothing is shuffled or stored,
    and filters on the other columns still pass.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def _parse_layer(df: DataFrame, fmt: LogFormat, gate: Column, carry: Sequence[str]) -> DataFrame:
    """Try one format on the rows where `gate` holds: adds `__event` and `__error` (both NULL on other rows)."""
    src = df.select(*carry, F.when(gate, F.regexp_replace(F.col("raw"), r"[\r\n]+\z", "")).alias("__raw"))
    out = fmt.extract(src.withColumn(ERROR, F.lit(None).cast("string")), F.col("__raw"))
    mapping = dict(fmt.mapping())
    if fmt.unmapped:
        out = collect_unmapped(out, fmt.unmapped, fmt.unmapped_drop, "__unmapped")
        mapping["unmapped"] = F.col("__unmapped")
    mapping["metadata.parser"] = F.lit(fmt.slug)
    out = normalize(out, mapping, fmt.cases(), to="__event", derive=True, required=fmt.required)
    tried = F.col("__raw").isNotNull()
    return out.select(*carry, F.when(tried & F.col(ERROR).isNull(), F.col("__event")).alias("__event"),
                      F.when(tried, F.col(ERROR)).alias("__error"))


def parse_auto(df: DataFrame, formats: Sequence[LogFormat]) -> DataFrame:
    """Try the formats that recognise a line until one parses it; adds `event`, `parser`, `status`, `error`.

    One pass over the input: every format sees only the rows that no earlier format has parsed, through a gated source
    column, so the input is read once whatever the number of formats. The last failure is the error.
    """
    keep = list(df.columns)
    out = df.withColumn("__fail", precheck_error(F.col("raw"))).withColumns({"__bad": F.col("__fail").isNotNull(), "__hit": F.lit(None).cast("string")})
    event_col = None
    for fmt in in_order(formats):
        carry = [*[f"`{c}`" for c in keep], "__bad", "__fail", "__hit", *(["event"] if event_col else [])]
        open_ = F.col("__hit").isNull() & ~F.col("__bad")
        layer = _parse_layer(out, fmt, open_ & F.coalesce(fmt.detect(F.col("raw")), F.lit(False)), carry)
        won = F.col("__event").isNotNull()
        merged = F.coalesce(F.col("event"), F.col("__event")) if event_col else F.col("__event")
        out = pinned(layer.select(*[f"`{c}`" for c in keep], "__bad", F.coalesce(F.col("__error"), F.col("__fail")).alias("__fail"),
                                  F.coalesce(F.col("__hit"), F.when(won, F.lit(fmt.slug))).alias("__hit"), merged.alias("event")),
                     "__fail", "__hit", "event")
        event_col = "event"
    parsed = F.col("__hit").isNotNull()
    done = out.select(*[f"`{c}`" for c in keep], F.col("event"), F.col("__hit").alias("parser"),
                      F.when(~parsed, F.coalesce(F.col("__fail"), F.lit("format not recognised by any active parser"))).alias(ERROR))
    return finish_status(done)


def parse_with(df: DataFrame, fmt: LogFormat) -> DataFrame:
    """Parse every line with one fixed format; a disabled format is the error of every line."""
    keep = list(df.columns)
    if not fmt.active:
        off = df.withColumn(ERROR, F.lit("the parser is disabled"))
        return finish_status(off.withColumn("parser", F.lit(None).cast("string")))
    layer = pinned(_parse_layer(df, fmt, precheck_error(F.col("raw")).isNull(), [f"`{c}`" for c in keep]), "__event", "__error")
    failed = F.when(F.col("__event").isNull(), F.coalesce(F.col("__error"), precheck_error(F.col("raw")), F.lit("empty line")))
    done = layer.select(
        *[f"`{c}`" for c in keep], F.col("__event").alias("event"),
        F.when(F.col("__event").isNotNull(), F.lit(fmt.slug)).alias("parser"), failed.alias(ERROR))
    return finish_status(done)


def resolve_parser(df: DataFrame, uploads: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `fixed_parser`: the parser of the upload, else of the source, else NULL for automatic detection."""
    from logloom.operators.joins import attach
    out = attach(df, uploads.select("upload_id", F.col("parser").alias("__up_parser")), ["upload_id"])
    out = attach(out, sources.select("source_id", F.col("parser").alias("__src_parser")), ["source_id"])
    return out.withColumn("fixed_parser", F.coalesce("__up_parser", "__src_parser")).drop("__up_parser", "__src_parser")


def parse_resolved(df: DataFrame, formats: Sequence[LogFormat]) -> DataFrame:
    """Parse with `fixed_parser` where it is set, automatically elsewhere, in the same single pass."""
    known = {f.slug for f in formats if f.active}
    fixed = F.col("fixed_parser")

    def gated(f: LogFormat) -> LogFormat:
        return LogFormat(f.slug, lambda raw: F.when(fixed.isNull(), f.detect(raw)).otherwise(fixed == f.slug), f.extract, f.mapping,
                         f.cases, f.unmapped, f.unmapped_drop, f.required, f.priority, f.active)
    out = parse_auto(df, [gated(f) for f in formats])
    lost = fixed.isNotNull() & ~fixed.isin(*known)
    return out.withColumn(ERROR, F.when(lost & (F.col("status") == "unparsed"), F.lit("the parser is disabled")).otherwise(F.col(ERROR)))


def parse_lines(df: DataFrame, formats: Sequence[LogFormat], fmt: str | None = None, out: str | None = None) -> DataFrame:
    """Stateless parse and render: adds `ok`, `parser`, `error` and, with `out`, the rendered line `output`."""
    from logloom.operators.render import render
    if fmt is None:
        parsed = parse_auto(df, formats)
    else:
        parsed = parse_with(df, next(f for f in formats if f.slug == fmt))
    parsed = parsed.withColumn("ok", F.col("status") == "parsed")
    if out is None:
        return parsed
    return parsed.withColumn("output", F.when(F.col("ok"), render(out, parsed, F.col("event"), F.col("raw"))))
