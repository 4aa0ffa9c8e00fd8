"""The catalog of sources, their snapshots, and the two queries about them.

A snapshot is a folder of Parquet tables, their indexes and package corpora that is never changed. Numbered versions, each a small file that only one writer can
create, name a generation; the last that can be read is the current one. There is no lock: writers work in generations of their own, to which they hold a claim with a
number. Who wants to go on with one that was left takes the next number, after which the first can't publish it any more. A reader resolves
the version once, so a query sees one generation whatever is published meanwhile: generations that are no longer current stay for ``grace`` seconds, for
the readers that still hold their tables. Everything goes through Spark's file systems, so writers and readers may be on any machine.

A generation's manifest has for each table the number of rows and a fingerprint, both taken while it is written, and a digest of its files' names and lengths, which every reader compares.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from . import assemblies, corpus_rules, inverted, markdown, packages, skipping
from .files import Files
from .packages import safe_framework, valid_package_id, valid_version

CATALOG_VERSION, STATE_VERSION = 1, 3
KEPT_VERSIONS = 20


@dataclass(frozen=True)
class Source:
    name: str
    repository: str
    url: str
    pin: str
    head: str
    sparse: list[str]
    purpose: str
    markdown: bool = False
    api_packages: list[dict] = field(default_factory=list)


def _defined(package: dict) -> bool:
    """Whether a package's definition is whole; what is not stated is not checked when it is fetched, and never counts as synced."""
    assembly = package.get("assemblyName") or package.get("packageId") or ""
    framework, version = package.get("defaultFramework"), package.get("version")
    named = valid_package_id(package.get("packageId")) and bool(assembly.strip()) and not re.search(r"[/\\:]", assembly)
    return named and str(package.get("feed", "")).startswith("https://") and safe_framework(framework) and (version is None or valid_version(version))


def read_catalog(text: str) -> dict[str, Source]:
    """The sources of a catalog; ValueError names the first that is incomplete."""
    data = json.loads(text)
    if data.get("schemaVersion") != CATALOG_VERSION or not data.get("sources"):
        raise ValueError("not a catalog of this version, or without sources")
    out = {}
    for name, d in data["sources"].items():
        texts = [d.get(k) for k in ("repository", "url", "pin", "head", "purpose")]
        sparse = d.get("sparse") or []
        unsafe = [p for p in sparse if not p.strip() or p[0] in "/\\-" or ":" in p or ".." in re.split(r"[/\\]", p)]
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name) or not all(t and t.strip() for t in texts) or not sparse or unsafe or d["head"].startswith("-") or not re.fullmatch("[0-9A-Fa-f]{40}", d["pin"]):
            raise ValueError(f"incomplete or invalid source {name!r}")
        listed = d.get("apiPackages") or []
        known = [str(p.get("packageId")).lower() for p in listed]
        if len(set(known)) != len(known) or not all(_defined(p) for p in listed):
            raise ValueError(f"source {name!r} has an invalid package")
        out[name] = Source(name, *texts[:4], sparse, texts[4], bool(d.get("markdown")), listed)
    return out


def _versions(files: Files, place: str) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names(f"{place}/versions") if re.fullmatch(r"\d+\.json", n))


def _published(files: Files, cache: str, name: str) -> dict | None:
    """The last published state that is written whole; none if there is no readable one of this version, or its tables or corpora are of another."""
    place = f"{cache}/{name}"
    for version in reversed(_versions(files, place)[-KEPT_VERSIONS:]):
        try:
            state = json.loads(files.read(f"{place}/versions/{version:012d}.json") or "null")
            fits = state["schemaVersion"] == STATE_VERSION and state.get("corpusSchema", corpus_rules.VERSION) == corpus_rules.VERSION
            return state if fits and files.exists(f"{place}/{state['generation']}") else None
        except Exception:  # noqa: BLE001  whatever is wrong with it, it isn't there yet
            continue
    return None


def read_state(spark: SparkSession, cache: str, name: str) -> dict | None:
    return _published(Files(spark), cache, name)


def _origin(source: Source, ref: str, commit: str) -> str:
    """What a generation is made of; two with one origin hold the same rows."""
    return json.dumps({"repository": source.repository, "url": source.url, "sparse": source.sparse, "ref": ref, "commit": commit, "packages": source.api_packages}, sort_keys=True)


def _begun(files: Files, place: str, origin: str, stale: float) -> tuple[str, int]:
    """(generation, claim): one of this origin that was left unpublished, or a new one."""
    for name in files.names(place):
        if name.startswith("gen-") and files.read(f"{place}/{name}/origin.json") == origin and not files.exists(f"{place}/{name}/published"):
            if (token := files.claim(f"{place}/{name}", stale)) is not None:
                return name, token
    name = f"gen-{uuid.uuid4().hex}"
    token = files.claim(f"{place}/{name}", stale)
    files.create(f"{place}/{name}/origin.json", origin)
    return name, token


def _write(df: DataFrame, path: str) -> dict:
    """Writes a table; its number of rows and an order-independent fingerprint, taken meanwhile."""
    seen = Observation()
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("sum"), F.bit_xor(row).alias("xor")).write.mode("overwrite").parquet(path)
    got = seen.get
    return {"rows": int(got.get("rows") or 0), "fingerprint": f"{got.get('sum') or 0}/{got.get('xor') or 0}"}


def _require_unique(spark: SparkSession, path: str, table: str) -> None:
    """Refuses a stored table in which an id is repeated. Ids are counted before they are shuffled; no other column is read."""
    again = spark.read.parquet(path).groupBy("declaration_id").agg(F.count("*").alias("n")).filter("n > 1 AND declaration_id IS NOT NULL").select("declaration_id").first()
    if again is not None:
        raise QueryError("source_invalid", f"{table} has the id {again[0]!r} more than once")


def _publish(files: Files, place: str, here: str, token: int, state: dict) -> dict:
    """Makes the state the next version, after those that others publish meanwhile; refused if the generation has been taken over."""
    version = (_versions(files, place) or [0])[-1]
    while True:
        version += 1
        if not files.holds(here, token):
            raise QueryError("sync_failed", "another writer has taken this generation over")
        if files.create(f"{place}/versions/{version:012d}.json", json.dumps(state | {"version": version})):
            return state | {"version": version}


def verify_tables(spark: SparkSession, cache: str, name: str, state: dict) -> list[str]:
    """The tables of a snapshot whose rows are not those that were written; reads all of them."""
    here, wrong = f"{cache}/{name}/{state['generation']}", []
    for t, m in state["manifest"].items():
        df = spark.read.parquet(f"{here}/{t}")
        row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])
        got = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
        if (got[0], f"{got[1] or 0}/{got[2] or 0}") != (m["rows"], m["fingerprint"]):
            wrong.append(t)
    return wrong


def build_index(spark: SparkSession, table: str, index: str, name: str) -> None:
    """The index of a stored table, if its kind has one: of types and uses by name, of prose and documents the trigrams of each file."""
    if name == "types":
        inverted.write_names(spark.read.parquet(table), index)
    elif name == "uses":
        inverted.write_uses(spark.read.parquet(table), index)
    elif name in ("prose", "docs"):
        skipping.build(spark, table, index, F.lower("text") if name == "prose" else F.col("text"))


def open_index(spark: SparkSession, table: str, index: str, name: str, only: str | None = None) -> inverted.Inverted | skipping.Skipping:
    if name in ("types", "uses"):
        return inverted.Inverted(spark, index, spark.read.parquet(table).schema, only=only)
    return skipping.Skipping(spark, table, index, folds=name == "prose", only=only)


INDEXED = ("types", "uses", "prose", "docs")


def indexes(spark: SparkSession, cache: str, name: str, state: dict) -> dict[str, inverted.Inverted | skipping.Skipping]:
    """The indexes of a snapshot's tables."""
    here = f"{cache}/{name}/{state['generation']}"
    return {t: open_index(spark, f"{here}/{t}", f"{here}/index/{t}", t) for t in state.get("indexes", [])}


STEPS = ("prepare", "read", "write", "publish", "prune")
PACKAGE_STEPS = ("prepare", "read", "write", "fetch packages", "validate packages", "build corpora", "publish", "prune")


def sync_source(
    spark: SparkSession, catalog: dict[str, Source], cache: str, name: str, build: Callable[[Source], dict[str, DataFrame]], ref: str | None = None, commit: str | None = None,
    progress: Callable[[int, int, str], None] = lambda i, n, what: None, fetch: Callable[[dict], bytes] | None = None, read_metadata: Callable[[bytes], dict] | None = None,
    grace: float = 24 * 3600.0, stale: float = 6 * 3600.0,
) -> dict:
    """Writes the tables that ``build`` gives, their indexes, and the corpora of the source's packages, as a new generation, then makes it the current one.

    A failure leaves the published generation as it was; what was written of the new one is taken up by the next attempt at the same
    origin, also if its writer has not been heard of for ``stale`` seconds. A source in which two types, or two members, have one id is refused. ``fetch`` gives the archive of a package's definition; ``read_metadata`` the corpus of an assembly, if not by its compiled metadata.
    """
    if name not in catalog:
        raise QueryError("unknown_source", f"no source {name!r}")
    if ref not in (None, "head"):
        raise QueryError("invalid_ref", "ref is omitted or head")
    source, files, place = catalog[name], Files(spark), f"{cache}/{name}"
    steps = PACKAGE_STEPS if source.api_packages else STEPS
    at = lambda what: progress(steps.index(what) + 1, len(steps), what)
    at("prepare")
    said, commit = source.head if ref else "pin", commit or source.pin
    generation, token = _begun(files, place, _origin(source, said, commit), stale)
    here, fetched = f"{place}/{generation}", datetime.now(UTC).isoformat()
    try:
        at("read")
        tables = build(source)
        if "docs" in tables:  # parsed once
            tables["docs"] = markdown.structured(tables["docs"])
        at("write")
        manifest = {}
        for table, df in tables.items():
            note = f"{here}/manifest/{table}.json"
            if not files.exists(note):
                entry = _write(df, f"{here}/{table}")
                if table in ("types", "members") and "declaration_id" in df.columns:
                    _require_unique(spark, f"{here}/{table}", table)
                files.create(note, json.dumps(entry | {"listing": files.listing(f"{here}/{table}")}), overwrite=True)
            manifest[table] = json.loads(files.read(note))
        indexed = [t for t in INDEXED if t in tables]
        for t in indexed:
            if not files.exists(f"{here}/index/{t}/_SUCCESS"):
                build_index(spark, f"{here}/{t}", f"{here}/index/{t}", t)
        supplements = [_supplement(spark, files, here, d, fetch, read_metadata, fetched, at) for d in source.api_packages]
    except Exception as e:
        if isinstance(e, QueryError):  # the content is refused; another attempt would find the same
            files.delete(here)
            raise
        files.release(here, token)
        raise QueryError("sync_failed", str(e)) from e
    at("publish")
    state = {
        "schemaVersion": STATE_VERSION, "name": name, "repository": source.repository, "url": source.url, "ref": said, "commit": commit, "fetchedAt": fetched, "sparse": source.sparse,
        "generation": generation, "tables": sorted(tables), "manifest": manifest, "indexes": indexed, "corpusSchema": corpus_rules.VERSION, "apiPackages": supplements,
    }
    files.create(f"{here}/published", fetched, overwrite=True)
    state = _publish(files, place, here, token, state)
    files.release(here, token)
    at("prune")
    now = datetime.now(UTC).timestamp()
    current = (_published(files, cache, name) or state)["generation"]
    for old in files.names(place):
        if old.startswith("gen-") and old not in (generation, current) and not files.claimed(f"{place}/{old}", stale) and now - files.changed(f"{place}/{old}") >= grace:
            files.delete(f"{place}/{old}")
    for version in _versions(files, place)[:-KEPT_VERSIONS]:
        files.delete(f"{place}/versions/{version:012d}.json")
    return state


def _supplement(spark: SparkSession, files: Files, here: str, definition: dict, fetch: Callable | None, read_metadata: Callable | None, fetched: str, at: Callable[[str], None]) -> dict:
    """The state of one package: its archive fetched, verified, and its corpora built and stored, a file of each framework."""
    if fetch is None:
        raise QueryError("sync_failed", f"package {definition['packageId']!r} needs a way to be fetched")
    read_metadata = read_metadata or (lambda dll: assemblies.read_named(dll, definition["assemblyName"]))
    at("fetch packages")
    content = fetch(definition)
    at("validate packages")
    packages.verify_sha512(content, definition["sha512"])
    archive = spark.createDataFrame([(definition["packageId"], bytearray(content))], "path string, content binary")
    assets = packages.read_archives(archive, definition["assemblyName"])
    at("build corpora")
    if (refused := assets.filter("error is not null").first()) is not None:
        raise QueryError("source_invalid", refused["error"])
    folder, frameworks = f"packages/{definition['packageId']}", []
    built = packages.build_corpora(assets, definition["packageId"], definition["version"], definition["sha512"], read_metadata)
    for r in built.toLocalIterator():  # a file at a time; each is bounded
        if r["error"]:
            raise QueryError("source_invalid", r["error"])
        files.create(f"{here}/{folder}/{r['framework']}.json", bytes(r["corpus"]), overwrite=True)
        frameworks.append(r["framework"])
    keys = ("packageId", "assemblyName", "version", "sha512", "feed", "defaultFramework")
    return {k: definition[k] for k in keys} | {"fetchedAt": fetched, "availableFrameworks": sorted(frameworks), "corpusDirectory": folder}


def _complete(state: dict) -> bool:
    try:
        digest = len(base64.b64decode(state["sha512"], validate=True)) == 64
        frameworks = [state["defaultFramework"], *state["availableFrameworks"]]
        safe = not re.search(r"[/\\:]", state["assemblyName"]) and bool(state["assemblyName"].strip()) and not re.search(r"^/|:|\\|(^|/)\.{0,2}(/|$)", state["corpusDirectory"])
        named = valid_package_id(state["packageId"]) and valid_version(state["version"]) and state["feed"].startswith("https://") and bool(state["fetchedAt"])
        return digest and safe and named and len(frameworks) > 1 and all(map(safe_framework, frameworks))
    except (KeyError, TypeError, AttributeError, binascii.Error, ValueError):
        return False


def supplement_state(definition: dict, state: dict | None) -> dict | None:
    """The synced state of a package, if there is exactly one, and it is that which the catalog describes now."""
    same = lambda a, b: str(a).lower() == str(b).lower()
    found = [p for p in (state or {}).get("apiPackages") or [] if same(p.get("packageId"), definition["packageId"])]
    if len(found) != 1 or not _complete(found[0]):
        return None
    p = found[0]
    fits = p["assemblyName"] == definition.get("assemblyName") and p["feed"] == definition.get("feed") and same(p["defaultFramework"], definition.get("defaultFramework"))
    fits = fits and any(same(f, definition["defaultFramework"]) for f in p["availableFrameworks"])
    pinned = state["ref"] != "pin" or (p["version"], p["sha512"]) == (definition.get("version"), definition.get("sha512"))
    return p if fits and pinned else None


def _current(state: dict | None, source: Source) -> bool:
    """Whether a state is of the source as the catalog describes it now."""
    if state is None or (state["repository"], state["url"], state["sparse"]) != (source.repository, source.url, source.sparse):
        return False
    return state["ref"] != "pin" or str(state["commit"]).lower() == source.pin.lower()


def snapshot(spark: SparkSession, catalog: dict[str, Source], cache: str, name: str) -> tuple[dict, dict[str, DataFrame]]:
    """(state, tables) of the current generation, if it is of the source as the catalog describes it now; all its packages must be."""
    if name not in catalog:
        raise QueryError("unknown_source", f"no source {name!r}")
    state, source = read_state(spark, cache, name), catalog[name]
    if not _current(state, source) or not all(supplement_state(d, state) for d in source.api_packages):
        raise QueryError("source_not_synced", f"sync {name!r} first")
    files, here = Files(spark), f"{cache}/{name}/{state['generation']}"
    if any(files.listing(f"{here}/{t}") != m["listing"] for t, m in state["manifest"].items()):
        raise QueryError("source_not_synced", f"files of {name!r} were changed or lost; sync it again")
    return state, {t: spark.read.parquet(f"{cache}/{name}/{state['generation']}/{t}") for t in state["tables"]}


def package_tables(spark: SparkSession, cache: str, name: str, state: dict) -> list[tuple[dict, dict[str, DataFrame]]]:
    """(state, tables) of each package of a snapshot, in the order in which they are composed."""
    order = ("packageId", "assemblyName", "version", "sha512", "feed", "defaultFramework")
    found = sorted(state.get("apiPackages") or [], key=lambda p: tuple(p[k] for k in order))
    read = lambda p: packages.corpus_tables(packages.read_corpora(spark, f"{cache}/{name}/{state['generation']}/{p['corpusDirectory']}"))
    return [(p, read(p)) for p in found]


_SUPPLEMENTS = "array<struct<package_id:string,assembly_name:string,feed:string,version:string,sha512:string,synced:boolean,fetched_at:string,default_framework:string,available_frameworks:array<string>>>"


def list_sources(spark: SparkSession, catalog: dict[str, Source], cache: str) -> DataFrame:
    """A row of each source: what it is, whether it and its packages are synced, at which commit, and what to do next."""
    rows = []
    for name, s in sorted(catalog.items()):
        state = read_state(spark, cache, name)
        state = state if _current(state, s) else None
        supplements = []
        for d in s.api_packages:
            p = supplement_state(d, state)
            shown = d | (p or {})
            supplements.append((d["packageId"], *(shown.get(k) for k in ("assemblyName", "feed", "version", "sha512")), p is not None, (p or {}).get("fetchedAt"), shown.get("defaultFramework"), (p or {}).get("availableFrameworks") or []))
        synced = state is not None and all(x[5] for x in supplements)
        place = f"{cache}/{name}" + (f"/{state['generation']}" if state else "")
        rows.append((name, s.repository, s.purpose, s.url, s.pin, s.head, synced, *((state or {}).get(k) for k in ("ref", "commit", "fetchedAt")), place, supplements, None if synced else f"sync_source({name!r})"))
    ddl = "name string, repository string, purpose string, url string, pin string, head_branch string, synced boolean, ref string, commit string, fetched_at string, cache_dir string"
    return spark.createDataFrame(rows, f"{ddl}, supplements {_SUPPLEMENTS}, next_action string")


def combined_note(*notes: str | None) -> str | None:
    """Notes in one, each a sentence of its own; none without any."""
    said = [n.strip() for n in notes if n and n.strip()]
    return " ".join(said) or None


def revision_key(kind: str, **parts: str | None) -> str:
    """What identifies the rows' revision; the time of fetching doesn't."""
    return json.dumps({"kind": kind, **{k: v for k, v in parts.items() if v is not None and k != "fetched_at"}}, separators=(",", ":"))


def as_json(source: Source) -> str:
    return json.dumps({k: v for k, v in asdict(source).items() if v is not None}, separators=(",", ":"))
