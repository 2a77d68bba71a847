import json

import pytest

from sextant.sources.documents import registry_records
from sextant.sources.registry import read_registry


def saved(folder, name, pages):
    for page, records in pages.items():
        (folder / f"{name}-{page}.json").write_text(json.dumps({"totalFilas": 99, "resultados": records}))


def record(n):
    return {"nregistro": f"0{n}", "nombre": f"Name {n}", "pactivos": "x", "atcs": [{"codigo": "A", "nivel": 1}, {"codigo": "B", "nivel": 5}], "docs": [{"tipo": 1, "url": f"http://x/{n}", "secc": True}]}


def flaky(folder, name, failures):
    """Pages of saved responses; each fails so many times before it is there."""
    folder = str(folder)

    def fetch(page):
        import os

        seen = f"{folder}/{name}-{page}.tries"
        tries = os.path.getsize(seen) if os.path.exists(seen) else 0
        with open(seen, "ab") as f:
            f.write(b".")
        if tries < failures:
            raise ConnectionError("HTTP 503")
        path = f"{folder}/{name}-{page}.json"
        return open(path).read() if os.path.exists(path) else ""

    return fetch


def test_pages_retries_and_the_end_of_a_range(spark, tmp_path):
    saved(tmp_path, "a", {p: [record(10 * p + k) for k in range(3)] for p in (1, 2, 3, 4, 6)} | {7: []})
    rows = read_registry(spark, flaky(tmp_path, "a", 2), pages=8, range=2, pause=0, wait=0)
    assert rows.rdd.getNumPartitions() == 4
    out = sorted(rows.collect(), key=lambda r: (r.page, r.place))
    # Page 5 has nothing, so its range ends before page 6; pages 7 and 8 have nothing.
    assert [(r.page, r.place, r.nregistro) for r in out] == [(p, k, f"0{10 * p + k}") for p in (1, 2, 3, 4) for k in range(3)]
    assert (tmp_path / "a-1.tries").read_text() == "..."


def test_records_feed_the_catalogue_and_missing_fields_are_null(spark, tmp_path):
    saved(tmp_path, "b", {1: [record(1), {"nregistro": "2"}]})
    out = registry_records(read_registry(spark, flaky(tmp_path, "b", 0), pages=1, pause=0)).orderBy("nregistro").collect()
    assert [(r.nregistro, r.atc, r.url_ficha_tecnica, r.ficha_segmentada) for r in out] == [("01", "B", "http://x/1", True), ("2", None, None, False)]


def test_a_page_that_stays_away_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="page 1 after 2 attempts"):
        read_registry(spark, flaky(tmp_path, "c", 99), pages=1, attempts=2, pause=0, wait=0).collect()
