"""The versioned index: after any changes it answers as one built anew."""

import random

import pytest

from ledgerlark.operators import index, search

WORDS = "cat dog bird fish tree stone river cloud".split()


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, t string")


def content(version):
    rows = version.rows.select("k", "term", "tf", "dl", "digest", "bucket").collect()
    return sorted(map(repr, rows))


def rebuilt(spark, df, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("new") / "i")
    index.create(df, "k", "t", folder)
    return index.opened(spark, folder, "k", "bigint")


def text(r):
    return None if r.random() < 0.1 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, 6)))


@pytest.mark.parametrize("seed", [1])
def test_follows_inserts_changes_and_deletes(spark, tmp_path_factory, monkeypatch, seed):
    monkeypatch.setattr(index, "SEGMENTS", 3)
    r, folder = random.Random(seed), str(tmp_path_factory.mktemp("index") / "i")
    rows = [(i, text(r)) for i in range(20)] + [(None, "cat"), (3, "dog"), (3, "dog")]
    index.create(table(spark, rows), "k", "t", folder)
    for _ in range(4):
        rows = [x for x in rows if r.random() > 0.15]
        rows = [(k, text(r)) if r.random() < 0.2 else (k, t) for k, t in rows]
        rows += [(r.choice([None, 3, 100 + r.randint(0, 50)]), text(r)) for _ in range(4)]
        index.refresh(table(spark, rows), "k", "t", folder)
        now, want = index.opened(spark, folder, "k", "bigint"), rebuilt(spark, table(spark, rows), tmp_path_factory)
        assert content(now) == content(want)
        for q in ("dog tree",):
            hits = [sorted(map(repr, search.bm25(v, q, False).collect())) for v in (now, want)]
            assert [h[:9] for h in hits[0]] == [h[:9] for h in hits[1]]


def test_nothing_is_written_without_a_change(spark, tmp_path):
    df = table(spark, [(1, "cat"), (2, None)])
    index.create(df, "k", "t", str(tmp_path / "i"))
    assert index.refresh(df, "k", "t", str(tmp_path / "i")) == 0
    assert index.opened(spark, str(tmp_path / "i"), "k", "bigint").version == 0


def test_only_changed_documents_are_cut_again(spark, tmp_path):
    folder = str(tmp_path / "i")
    index.create(table(spark, [(i, f"cat{i} dog") for i in range(50)]), "k", "t", folder)
    assert index.refresh(table(spark, [(i, f"cat{i} dog" if i != 7 else "fish") for i in range(50)]), "k", "t", folder) == 1
    now = index.opened(spark, folder, "k", "bigint")
    assert now.rows.where("segment = 1").select("k").distinct().collect() == [(7,)]
    assert [r.k for r in search.bm25(now, "fish").collect()] == [7] and search.bm25(now, "cat7").count() == 0


def test_an_older_version_stays_readable(spark, tmp_path):
    folder = str(tmp_path / "i")
    index.create(table(spark, [(1, "cat")]), "k", "t", folder)
    index.refresh(table(spark, [(2, "dog")]), "k", "t", folder)
    index.merge(spark, folder, "k", "bigint")
    found = lambda v, q: [r.k for r in search.bm25(index.opened(spark, folder, "k", "bigint", v), q).collect()]
    assert found(0, "cat") == [1] and found(1, "cat") == [] and found(2, "dog") == found(None, "dog") == [2]


def test_an_overwritten_table_is_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    search_of = lambda q: sorted(r.k for r in search.bm25(index.index_of(spark.read.parquet(path), "k", "t"), q).collect())
    table(spark, [(1, "cat here"), (2, "dog here")]).write.parquet(path)
    assert search_of("here") == [1, 2] and search_of("here") == [1, 2]
    table(spark, [(2, "dog here"), (7, "new here"), (8, "cat")]).write.mode("overwrite").parquet(path)
    assert search_of("here") == [2, 7] and search_of("cat") == [8]
    table(spark, [(9, "late here")]).write.mode("append").parquet(path)
    assert search_of("here") == [2, 7, 9]


def test_a_failed_batch_leaves_the_version_before(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "i")
    index.create(table(spark, [(1, "cat")]), "k", "t", folder)
    monkeypatch.setattr(index, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.refresh(table(spark, [(2, "cat")]), "k", "t", folder)
    assert [r.k for r in search.bm25(index.opened(spark, folder, "k", "bigint"), "cat").collect()] == [1]


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "i")
    index.create(table(spark, []), "k", "t", folder)
    assert search.bm25(index.opened(spark, folder, "k", "bigint"), "cat").count() == 0
    assert index.refresh(table(spark, [(1, "cat")]), "k", "t", folder) == 1
    assert index.refresh(table(spark, []), "k", "t", folder) == 1
    assert search.bm25(index.opened(spark, folder, "k", "bigint"), "cat").count() == 0
