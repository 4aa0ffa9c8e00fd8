"""Snapshots without locks: numbered versions, claims, manifests and unique ids."""

import json
import os
import threading

import pytest

from quarry.errors import QueryError
from quarry.sources import catalog
from quarry.sources.files import Files

SOURCE = {"repository": "o/r", "url": "https://example.org/r.git", "pin": "a" * 40, "head": "main", "sparse": ["docs"], "purpose": "p", "markdown": True}


@pytest.fixture
def known():
    return catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"s": SOURCE}}))


def made(spark, *texts):
    return lambda s: {"docs": spark.createDataFrame([("r", f"{i}.md", t) for i, t in enumerate(texts)], "repo string, path string, text string")}


def text_of(spark, known, cache):
    return sorted(r.text for r in catalog.snapshot(spark, known, cache, "s")[1]["docs"].collect())


def test_one_of_many_creates_a_file(spark, tmp_path):
    files, won = Files(spark), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if files.create(f"{tmp_path}/x/v", str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read(f"{tmp_path}/x/v") == str(won[0])


def test_two_writers_both_publish_whole_versions(spark, tmp_path, known):
    cache, inside = str(tmp_path), threading.Barrier(2)

    def build(text):
        def of(s):
            inside.wait(60)  # both have begun
            return made(spark, text)(s)

        return of

    out, threads = [], []
    for text in ("one", "two"):
        threads.append(threading.Thread(target=lambda text=text: out.append((text, catalog.sync_source(spark, known, cache, "s", build(text))))))
        threads[-1].start()
    for t in threads:
        t.join()
    assert sorted(s["version"] for _, s in out) == [1, 2] and len({s["generation"] for _, s in out}) == 2
    last = max(out, key=lambda o: o[1]["version"])
    assert text_of(spark, known, cache) == [last[0]] and catalog.read_state(spark, cache, "s")["version"] == 2


def test_an_expired_claim_is_taken_over_and_its_first_holder_cannot_publish(spark, tmp_path, known):
    cache, files, errors = str(tmp_path), Files(spark), []
    taken = {}

    def slow(s):  # while the first writer reads, its claim expires and a second one publishes the same generation
        gen = next(n for n in os.listdir(tmp_path / "s") if n.startswith("gen-"))
        claim = tmp_path / "s" / gen / "claims" / f"{1:012d}"
        os.utime(claim, (1, 1))
        taken.update(catalog.sync_source(spark, known, cache, "s", made(spark, "second")))
        assert taken["generation"] == gen
        return made(spark, "first")(s)

    with pytest.raises(QueryError) as e:
        catalog.sync_source(spark, known, cache, "s", slow)
    errors.append(str(e.value))
    assert e.value.code == "sync_failed" and "taken" in errors[0]
    assert catalog.read_state(spark, cache, "s")["version"] == taken["version"] == 1 and text_of(spark, known, cache) == ["second"]
    assert files.claim(f"{cache}/s/other", 60) == 1 and files.claim(f"{cache}/s/other", 60) is None
    files.release(f"{cache}/s/other", 1)
    assert files.claim(f"{cache}/s/other", 60) == 2 and not files.holds(f"{cache}/s/other", 1)


def test_a_version_that_is_being_written_is_not_read(spark, tmp_path, known):
    cache = str(tmp_path)
    catalog.sync_source(spark, known, cache, "s", made(spark, "old"))
    (tmp_path / "s/versions/000000000002.json").write_text('{"schemaVersion": 3, "gen')
    assert text_of(spark, known, cache) == ["old"]
    state = catalog.sync_source(spark, known, cache, "s", made(spark, "new"))
    assert state["version"] == 3 and text_of(spark, known, cache) == ["new"]


@pytest.mark.parametrize("harm", ["lost", "changed", "added"])
def test_changed_files_are_noticed(spark, tmp_path, known, harm):
    cache = str(tmp_path)
    state = catalog.sync_source(spark, known, cache, "s", made(spark, "a", "b", "c"))
    assert state["manifest"]["docs"]["rows"] == 3 and catalog.verify_tables(spark, cache, "s", state) == []
    folder = tmp_path / "s" / state["generation"] / "docs"
    part = next(folder.glob("part-*.parquet"))
    if harm == "lost":
        part.unlink()
    elif harm == "changed":
        part.write_bytes(part.read_bytes() + b"x")
    else:
        (folder / "part-more.parquet").write_bytes(part.read_bytes())
    with pytest.raises(QueryError) as e:
        catalog.snapshot(spark, known, cache, "s")
    assert e.value.code == "source_not_synced"
    if harm == "added":
        assert catalog.verify_tables(spark, cache, "s", state) == ["docs"]


@pytest.mark.parametrize("table", ["types", "members"])
def test_repeated_ids_are_refused(spark, tmp_path, known, table):
    columns = {"types": "declaration_id string, namespace string, type_name string, full_name string", "members": "declaration_id string, type_id string, name string, signature string"}[table]
    rows = lambda *ids: {table: spark.createDataFrame([(i, "A", "B", "A.B") for i in ids], columns)}
    with pytest.raises(QueryError) as e:
        catalog.sync_source(spark, known, str(tmp_path), "s", lambda s: rows("T:A", "T:B", "T:A"))
    assert e.value.code == "source_invalid" and "T:A" in str(e.value) and catalog.read_state(spark, str(tmp_path), "s") is None
    assert catalog.sync_source(spark, known, str(tmp_path), "s", lambda s: rows("T:A", "T:B"))["version"] == 1
