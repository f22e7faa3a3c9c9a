"""Tables are replaced as a whole, whatever dies in between."""

import pytest

from viewtide.sources import files, publication as P


def values(spark, path):
    return sorted(r.id for r in P.open_table(spark, path).collect())


def names(folder):
    return sorted(p.name for p in folder.iterdir())


class Death(Exception):
    pass


def dies(*args):
    raise Death


def test_publish_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5, 0):
        P.publish(spark.range(n), path)
        assert values(spark, path) == list(range(n)) and names(tmp_path) == ["t"]


def test_a_table_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(spark.range(3), path)
    P.publish(spark.read.parquet(path).selectExpr("id + 1 as id"), path)
    assert values(spark, path) == [1, 2, 3]


@pytest.mark.parametrize("step, want", [("before", [0, 1, 2]), ("between", [0, 1, 2, 3, 4]), ("after", [0, 1, 2, 3, 4])])
def test_death_between_the_steps(spark, tmp_path, monkeypatch, step, want):
    path = str(tmp_path / "t")
    P.publish(spark.range(3), path)
    real, renames = P.Folder.rename, []

    def rename(self, source, target):
        if step == "before" or (step == "between" and renames):
            raise Death
        renames.append(source)
        real(self, source, target)

    with monkeypatch.context() as m:
        m.setattr(P.Folder, "rename", rename)
        if step == "after":
            m.setattr(P.Folder, "remove", dies)
        with pytest.raises(Death):
            P.publish(spark.range(5), path)
    assert values(spark, path) == want and names(tmp_path) == ["t"]
    P.publish(spark.range(7), path)
    assert values(spark, path) == list(range(7)) and names(tmp_path) == ["t"]


def test_an_incomplete_new_table_is_not_taken(spark, tmp_path):
    path = tmp_path / "t"
    P.publish(spark.range(3), str(path))
    mark = "0" * 32
    path.rename(tmp_path / f".old-t-{mark}")
    (tmp_path / f".new-t-{mark}").mkdir()
    (tmp_path / f".new-t-{mark}" / "part-0.parquet").write_bytes(b"half")
    assert values(spark, str(path)) == [0, 1, 2]


def test_first_publication_that_died(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with monkeypatch.context() as m:
        m.setattr(P, "swap", dies)
        with pytest.raises(Death):
            P.publish(spark.range(2), path)
    assert values(spark, path) == [0, 1]


def test_other_tables_are_left_alone(spark, tmp_path):
    for name in ("t", "t2", "t-1"):
        P.publish(spark.range(len(name)), str(tmp_path / name))
    (tmp_path / f".new-t-1-{'0' * 32}").mkdir()      # a swap of t-1 under way
    P.publish(spark.range(9), str(tmp_path / "t"))
    assert (tmp_path / f".new-t-1-{'0' * 32}").exists()
    assert values(spark, str(tmp_path / "t2")) == [0, 1] and values(spark, str(tmp_path / "t-1")) == [0, 1, 2]


def test_a_half_swapped_run_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    frame = lambda n: spark.range(n).selectExpr("id", "'r' as run_id")
    files.replace_run(frame(2), path, "r")
    with monkeypatch.context() as m:
        m.setattr(P, "swap", dies)
        with pytest.raises(Death):
            files.replace_run(frame(5), path, "r")
    assert spark.read.parquet(path).count() == 2      # the new rows lie aside, unseen
    files.replace_run(frame(4), path, "r")
    assert spark.read.parquet(path).count() == 4
