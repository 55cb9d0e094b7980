"""Ledger (K4-K6, S5, J3, F12, F13, A5, A7) and statistics (A1, A9) with real folders."""

import datetime as dt
import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from rollscan.operators.stats import error_summary, run_stats
from rollscan.params import SearchParams
from rollscan.session import materialize
from rollscan.sinks.ledger import Ledger, file_hashes, names_hash, names_hash_expr
from rollscan.sources.files import scan_pdf_files

NOW = dt.datetime(2026, 1, 31, 12, 0, 0)


def _files(spark, root, items):
    for name, data in items.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
    return scan_pdf_files(spark, root)


def _results(spark, rows):
    return spark.createDataFrame(rows, "path string, file string, page int, name string, father string")


def test_names_hash_matches_python(spark):
    names = ["রহিম", "করিম", "আলী", "করিম", "z|a", None]
    want = hashlib.sha256("|".join(sorted(n for n in names if n)).encode()).hexdigest()[:16]
    frame = lambda rows: spark.createDataFrame([(n,) for n in rows], "query string")
    assert names_hash(frame(names)) == names_hash(frame(names[::-1])) == names_hash(frame(names), most=0) == want
    assert names_hash(frame(names[:3])) != want and len(names_hash(frame([]))) == 16
    assert frame(names).agg(names_hash_expr(F.col("query"))).first()[0] == want  # the form of the query by list


def test_settings_hold_every_parameter_that_changes_rows():
    base = SearchParams()
    changed = [dict(threshold=81), dict(box_level=True), dict(min_confidence=61), dict(max_pdf_size_mb=49), dict(max_pdf_pages=100),
               dict(word_match_threshold=71), dict(layout="lines"), dict(strict_labels=True), dict(all_records=True),
               dict(name_label="Name"), dict(guardian_labels=("Father",))]
    assert len({base.settings(), *(SearchParams(**c).settings() for c in changed)}) == len(changed) + 1
    assert base.settings() == SearchParams(ttl_days=3, strategy="shuffle", min_confidence=60).settings()


def test_now_is_the_same_instant_in_every_session_zone(spark):
    from rollscan.sinks.ledger import ts_literal

    found = set()
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Dhaka"):
            spark.conf.set("spark.sql.session.timeZone", z)
            found.add(spark.range(1).select(F.unix_micros(ts_literal(NOW)).alias("t")).first()["t"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == {int(NOW.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)}


def test_ledger_round_trip(spark):
    root = tempfile.mkdtemp(prefix="rollscan-ledger-")
    files = _files(spark, os.path.join(root, "pdfs"), {"test.pdf": b"%PDF-test", "other.pdf": b"%PDF-other"})
    path = files.where(F.col("path").endswith("test.pdf")).first()["path"]
    p80 = SearchParams(threshold=80)
    led = Ledger(spark, os.path.join(root, "ledger"), p80)
    hits, misses = led.lookup(files, "abc", NOW)
    assert hits.count() == 0 and misses.count() == 2  # miss on first look-up

    led.append(file_hashes(files), _results(spark, [(path, "test.pdf", 1, "test", "t")]), "abc", 1, NOW)
    hits, misses = led.lookup(files, "abc", NOW)
    assert [(r.file, r.page, r.name) for r in hits.collect()] == [("test.pdf", 1, "test")]
    assert misses.count() == 0  # other.pdf was stored with zero results: a hit without rows
    assert "content" in misses.columns and led.misses(file_hashes(files), "abc", NOW).count() == 0

    led90 = Ledger(spark, os.path.join(root, "ledger"), SearchParams(threshold=90))
    assert led90.lookup(files, "abc", NOW)[1].count() == 2  # other threshold misses
    boxed = Ledger(spark, os.path.join(root, "ledger"), SearchParams(threshold=80, box_level=True))
    assert boxed.lookup(files, "abc", NOW)[1].count() == 2  # box runs do not share text entries

    # TTL: aged exactly 30 days is valid, one microsecond more is not
    later = NOW + dt.timedelta(days=30)
    assert led.lookup(files, "abc", later)[1].count() == 0
    assert led.lookup(files, "abc", later + dt.timedelta(microseconds=1))[1].count() == 2

    # newest entry wins
    led.append(file_hashes(files), _results(spark, [(path, "test.pdf", 2, "new", "t")]), "abc", 1, NOW + dt.timedelta(hours=1))
    hits, _ = led.lookup(files, "abc", NOW + dt.timedelta(hours=2))
    assert [r.name for r in hits.collect()] == ["new"]

    st = led.stats().first()
    assert st["total_entries"] == 4 and st["total_size_mb"] > 0 and st["ttl_days"] == 30

    assert led.clear_expired(NOW + dt.timedelta(days=30, minutes=30)) == 2
    assert led.stats().first()["total_entries"] == 2
    assert led.clear() == 2
    assert led.lookup(files, "abc", NOW)[1].count() == 2  # miss after clear


def test_run_stats_and_error_summary(spark):
    files = spark.createDataFrame([(f"/d/f{i}.pdf",) for i in range(5)], "path string")
    errors = spark.createDataFrame(
        [(f"/d/f{i}.pdf", None, "file", f"f{i}.pdf: broken") for i in (1, 2)]
        + [(f"/d/f0.pdf", p, "page", f"Error processing page {p}: x") for p in range(1, 12)],
        "path string, page int, level string, message string",
    )
    pages = spark.createDataFrame([(1,)] * 7, "page int")
    matches = spark.createDataFrame([(1,)] * 3, "x int")
    s = run_stats(files, errors, pages, matches).first()
    assert (s.files_processed, s.files_failed, s.pages_processed, s.matches_found, s.error_count) == (3, 2, 7, 3, 13)
    assert s.errors[:2] == ["f0.pdf: Error processing page 1: x", "f0.pdf: Error processing page 2: x"] and len(s.errors) == 10
    e = error_summary(errors).first()
    assert e.error_count == 13 and len(e.first_errors) == 10 and e.more == "... and 3 more"
    assert e.first_errors[0] == "f0.pdf: Error processing page 1: x"


def test_lookup_never_shuffles_file_bytes(spark):
    root = tempfile.mkdtemp(prefix="rollscan-ledger-")
    files = _files(spark, os.path.join(root, "pdfs"), {"a.pdf": b"%PDF-a", "b.pdf": b"%PDF-b"})
    led = Ledger(spark, os.path.join(root, "ledger"), SearchParams())
    hashes = file_hashes(files)
    for done in (hashes.limit(0), hashes.where("path like '%a.pdf'"), hashes):
        led.append(done, _results(spark, []), "h", 1, NOW)
        _, todo = led.lookup(files, "h", NOW)
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_another_session_sees_the_entries(spark):
    """The folder is the ledger: a second declaration of the table over it finds what is there."""
    root = tempfile.mkdtemp(prefix="rollscan-ledger-")
    files = _files(spark, os.path.join(root, "pdfs"), {"a.pdf": b"%PDF-a"})
    led = Ledger(spark, os.path.join(root, "ledger"), SearchParams())
    led.append(file_hashes(files), _results(spark, []), "h", 1, NOW)
    spark.sql(f"DROP TABLE {led.table}")
    again = Ledger(spark, os.path.join(root, "ledger"), SearchParams())
    assert again.stats().first()["total_entries"] == 1 and again.misses(file_hashes(files), "h", NOW).count() == 0


def test_lookup_shuffles_no_ledger_entries(spark):
    root = tempfile.mkdtemp(prefix="rollscan-ledger-")
    files = _files(spark, os.path.join(root, "pdfs"), {f"{i}.pdf": b"%PDF-" + bytes([i]) for i in range(9)})
    led = Ledger(spark, os.path.join(root, "ledger"), SearchParams())
    hashes = materialize(file_hashes(files))
    led.append(hashes.where("path not like '%8.pdf'"), _results(spark, []), "h", 1, NOW)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        misses = led.misses(hashes, "h", NOW)
        plan = misses._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "SortMergeJoin" in plan
        assert [r["path"][-5:] for r in misses.collect()] == ["8.pdf"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_expiry_keeps_what_is_appended_meanwhile(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="rollscan-ledger-")
    files = _files(spark, os.path.join(root, "pdfs"), {n: b"%PDF-" + n.encode() for n in ("old.pdf", "cut.pdf", "edge.pdf", "new.pdf")})
    hashes = materialize(file_hashes(files))
    one = lambda n: hashes.where(F.col("path").endswith(n))
    led = Ledger(spark, os.path.join(root, "ledger"), SearchParams())
    limit = NOW - dt.timedelta(days=30)
    led.append(one("old.pdf"), _results(spark, []), "h", 1, limit - dt.timedelta(days=3))
    led.append(one("cut.pdf"), _results(spark, []), "h", 1, limit - dt.timedelta(minutes=1))
    led.append(one("edge.pdf"), _results(spark, []), "h", 1, limit)  # the same day as the one before, still valid
    whole, other = Ledger._drop_partitions, Ledger(spark, os.path.join(root, "ledger"), SearchParams())

    def meanwhile(self, which):
        other.append(one("new.pdf"), _results(spark, []), "h", 1, NOW)
        whole(self, which)

    monkeypatch.setattr(Ledger, "_drop_partitions", meanwhile)
    assert led.clear_expired(NOW) == 2
    left = sorted(os.path.basename(r["pdf_path"]) for r in led.entries().collect())
    assert left == ["edge.pdf", "new.pdf"]
    assert sorted(r["path"][-7:] for r in led.misses(hashes, "h", NOW).collect()) == ["cut.pdf", "old.pdf"]
    monkeypatch.undo()
    assert led.clear_expired(NOW) == 0 and led.stats().first()["total_entries"] == 2
