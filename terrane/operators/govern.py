"""Guards: data rights, look-ahead, licences, reports whose figures must be in the run."""

from __future__ import annotations

import re
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from terrane.params import Params


class GuardError(PermissionError):
    """What is asked for may not leave, or looks ahead."""


#: Columns that hold licensed raw data, as patterns.
BLOCKED = (r"^price_.*_raw$", r"^listing_", r"_poi_count$", r"^ask_", r"^registration_", r"^footprint")


def column_names(schema: StructType, at: str = "") -> list[str]:
    """All names, those inside structs, arrays and maps too."""
    out = []
    for f in schema.fields:
        out.append(f.name)
        kind = f.dataType
        while isinstance(kind, (ArrayType, MapType)):
            kind = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
        if isinstance(kind, StructType):
            out += column_names(kind, f.name)
    return out


def exposable(df: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """df, if none of its columns holds raw licensed data."""
    bad = [n for n in column_names(df.schema) if any(re.search(b, n) for b in blocked)]
    if bad:
        raise GuardError(f"raw columns: {bad}")
    return df


def no_lookahead(df: DataFrame, t0: int, *dates: str) -> DataFrame:
    """df, if no year or date in it lies after t0; one pass for all columns."""
    kinds = dict(df.dtypes)
    year = lambda c: F.col(c) if kinds[c] in ("bigint", "int") else F.year(c)
    got = df.agg(*[F.count_if(year(c) > t0).alias(c) for c in dates]).first()
    late = {c: got[c] for c in dates if got[c]}
    if late:
        raise GuardError(f"rows after {t0}: {late}")
    return df


def vintage_ok(vintages: dict[str, int | None], t0: int, max_age: int) -> None:
    """Every attribute declares a data year, not after t0 and not older than max_age."""
    bad = {k: v for k, v in vintages.items() if v is None or v > t0 or v < t0 - max_age}
    if bad:
        raise GuardError(f"vintages undeclared, future or stale: {bad}")


_REFERENCE = re.compile(r"\[([A-Za-z0-9_.]+)\]")
_NUMBER = re.compile(r"-?\d[\d,]*\.?\d*")


def field_at(tree: object, path: str) -> object:
    """Value at a dotted path through dicts and lists."""
    for step in path.split("."):
        tree = tree[int(step)] if isinstance(tree, list) else tree[step]
    return tree


def unverified(text: str, data: dict, rel: float = 0.01, absolute: float = 0.005) -> list[str]:
    """References of a text without a number within tolerance in the 80 characters before them, or without a field."""
    bad = []
    for m in _REFERENCE.finditer(text):
        try:
            value = float(field_at(data, m[1]))
        except (KeyError, IndexError, ValueError, TypeError):
            bad.append(m[1])
            continue
        said = [float(x.replace(",", "")) for x in _NUMBER.findall(_REFERENCE.sub(" ", text[max(0, m.start() - 80) : m.start()]))]
        if not any(abs(x - value) <= max(absolute, rel * abs(value)) for x in said):
            bad.append(m[1])
    return bad


#: Blanks that are collapsed, the same in every engine.
_BLANKS = r"[ \t\n\x0B\f\r]+"


def strip_references(text: str) -> str:
    """The text without [references], and single blanks."""
    return re.sub(_BLANKS, " ", _REFERENCE.sub("", text)).strip(" ")  # references to figures stay: they name a picture


def stripped(text: Column) -> Column:
    """strip_references as a column."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _REFERENCE.pattern, ""), _BLANKS, " "))


_FIGURE = re.compile(r"\[figure:([A-Za-z0-9_.-]+)\]")


def figure_problems(references: DataFrame, figures: DataFrame) -> DataFrame:
    """(figure, problem): referenced and not made, made and not referenced, or made twice. references (figure),
    figures (figure): two anti joins and one count."""
    known, said = figures.select("figure"), references.select("figure").distinct()
    dangling = said.join(known, "figure", "left_anti").select("figure", F.lit("never made").alias("problem"))
    orphan = known.distinct().join(said, "figure", "left_anti").select("figure", F.lit("never referenced").alias("problem"))
    twice = known.groupBy("figure").count().filter("count > 1").select("figure", F.lit("made twice").alias("problem"))
    return dangling.unionByName(orphan).unionByName(twice)


def verify_report(sections: list[tuple[str, str]], figures: list[str], data: dict, every: bool = True) -> int:
    """The number of references checked, if the report holds: each [figure:id] was made, each figure made is referenced
    (with every), none was made twice, and each [path] has its number beside it. Else it raises, with all that is wrong."""
    said = [x for _, body in sections for x in _FIGURE.findall(body)]
    problems = [f"{x} was never made" for x in sorted(set(said) - set(figures))] + [f"{x} was made twice" for x in sorted({x for x in figures if figures.count(x) > 1})]
    if every:
        problems += [f"{x} is never referenced" for x in sorted(set(figures) - set(said))]
    n = len(said)
    for head, body in sections:
        plain = _FIGURE.sub("", body)
        n += len(_REFERENCE.findall(plain))
        problems += [f"{head}: {x}" for x in unverified(plain, data)]
    if problems:
        raise GuardError("; ".join(problems))
    return n


def render_report(title: str, sections: list[tuple[str, str]], data: dict, provenance: dict) -> str:
    """A report as text; refused where a reference is not borne out."""
    bad = {head: found for head, body in sections if (found := unverified(body, data))}
    if bad:
        raise GuardError(f"unverified references: {bad}")
    lines = [f"# {title}", *(f"\n## {head}\n{strip_references(body)}" for head, body in sections), "\n## Provenance", *(f"- {k}: {v}" for k, v in sorted(provenance.items()))]
    return "\n".join(lines)


def licence_audit(used: DataFrame, registry: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Sources without an entry in the registry, or with a class that is not allowed."""
    rows = used.join(registry, "source", "left")
    return rows.filter(F.col("class").isNull() | ~F.col("class").isin(*allowed)).select("source", F.when(F.col("class").isNull(), "undeclared").otherwise(F.col("class")).alias("problem"))


def parameter_provenance(p: Params, namespaces: tuple[str, ...] | None = None) -> list[dict]:
    """Global leaves with the data that they were fitted on and their citation, in order of path."""
    out = []
    for path in p.paths():
        leaf = p.leaf(path)
        if leaf["scope"] == "global" and (namespaces is None or path.partition(".")[0] in namespaces):
            fitted = leaf.get("fitted_on") or {}
            out.append({"path": path, "data_through": fitted.get("data_through"), "cities": tuple(fitted.get("cities") or ()), "citation": leaf.get("citation")})
    return out


def check_parameter_provenance(p: Params, t0: int, namespaces: tuple[str, ...] | None = None, allow_equal: bool = True, require: bool = False) -> list[dict]:
    """The records, if no parameter was fitted on data after t0 (or of t0, unless that is allowed); with require, each
    must say what it was fitted on or cite a source."""
    records = parameter_provenance(p, namespaces)
    late = [r["path"] for r in records if r["data_through"] is not None and (r["data_through"] > t0 or (r["data_through"] == t0 and not allow_equal))]
    if late:
        raise GuardError(f"fitted on data after {t0}: {late}")
    bare = [r["path"] for r in records if r["data_through"] is None and not r["citation"]]
    if require and bare:
        raise GuardError(f"without a fit or a citation: {bare}")
    return records


def write_estimates(path: Path, updates: dict[str, float], cities: list[str], data_through: int) -> list[str]:
    """Writes fitted values into a file of parameters with what they were fitted on; refuses local leaves, all or none."""
    tree = yaml.safe_load(Path(path).read_text())

    def leaf(at: str) -> dict:
        node = tree
        for step in at.split("."):
            node = node[step]
        return node

    local = [x for x in sorted(updates) if leaf(x).get("scope") != "global"]
    if local:
        raise GuardError(f"local parameters are calibrated by city: {local}")
    for x, value in updates.items():
        leaf(x)["value"] = value
        leaf(x)["fitted_on"] = {"cities": list(cities), "data_through": int(data_through)}
    Path(path).write_text(yaml.safe_dump(tree, sort_keys=False))
    return sorted(updates)


def dependency_audit(installed: DataFrame, policy: DataFrame, direct: list[str], documented: list[str]) -> DataFrame:
    """(package, version, licence, class, problem), a row a package; problem is null where there is none.

    installed (package, version, licence), policy (licence, class). Red licences are refused, an unknown one only of a
    direct dependency, which also must be documented.
    """
    name = F.regexp_replace(F.lower("package"), "[-_.]+", "-")
    norm = lambda xs: sorted({re.sub(r"[-_.]+", "-", x.lower()) for x in xs}) or [""]
    rows = installed.withColumn("_l", F.lower(F.trim("licence"))).join(F.broadcast(policy.select(F.lower(F.trim("licence")).alias("_l"), "class").distinct()), "_l", "left")
    rows = rows.withColumn("class", F.coalesce("class", F.lit("unknown")))
    is_direct = name.isin(*norm(direct))
    problem = F.when(F.col("class") == "red", "licence not permitted").when((F.col("class") == "unknown") & is_direct, "licence unknown").when(is_direct & ~name.isin(*norm(documented)), "not documented")
    return rows.select("package", "version", "licence", "class", problem.alias("problem"))


def attribution_text(sources: dict[str, dict], used: list[str] | None = None) -> str:
    """Lines that sources must be credited with; a source that no registry entry or alias names raises."""
    names = {alias: key for key, x in sources.items() for alias in (key, *x.get("aliases", ()))}
    lost = [u for u in used or () if u not in names]
    if lost:
        raise GuardError(f"no attribution for {lost}")
    keys = list(sources) if used is None else [names[u] for u in used]
    return "\n".join(dict.fromkeys(sources[k]["attribution"] for k in keys if sources[k].get("attribution")))


def source_provenance(source: str, sources: dict[str, dict], licences: dict[str, dict]) -> dict:
    """What both registries say of a source; one that either lacks raises."""
    lost = [name for name, table in (("sources", sources), ("licences", licences)) if source not in table]
    if lost:
        raise GuardError(f"{source} is not in {lost}")
    return {"source": source, **sources[source], **{f"licence_{k}": v for k, v in licences[source].items()}}


def confidence_tags(p: Params, paths: list[str], known: tuple[str, ...] = ("E", "R", "G")) -> dict[str, str]:
    """The confidence of each parameter behind a headline number; an unknown tag raises."""
    tags = {x: p.leaf(x)["conf"] for x in paths}
    odd = {k: v for k, v in tags.items() if v not in known}
    if odd:
        raise GuardError(f"unknown confidence {odd}")
    return tags


def report_provenance(p: Params, run: dict, headline: list[str], city: str, level: str) -> dict:
    """The block that every report carries: city, hashes, code, calibration and the tags of its headline parameters."""
    return {"city": city, "calibration": level, **run, "tags": confidence_tags(p, headline)}


def calibration_flag(block: dict, level: str = "class_defaults", text: str = "Parameters are class defaults, not calibrated to this city.") -> str | None:
    """What reports of a city without its own calibration must say."""
    return text if block["calibration"] == level else None


def check_coverage(report: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """A coverage report (column, real, ...), if every column with a threshold reaches it; one it lacks fails too."""
    got = {r["column"]: r["real"] for r in report.filter(F.col("column").isin(*thresholds)).select("column", "real").collect()}  # a row a column
    bad = {k: got.get(k) for k, least in thresholds.items() if got.get(k) is None or got[k] < least}
    if bad:
        raise GuardError(f"columns below their threshold: {bad}")
    return report
