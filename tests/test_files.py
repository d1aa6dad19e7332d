from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from covaria.functions import keys as K
from covaria.operators import sentences as SE
from covaria.sources import readers as R
from covaria.sources import records, wide
from covaria.sources import writers as W
from covaria.sources.schemas import NOTES

HEADER = ",".join(NOTES.names)


@pytest.fixture
def tiny_slices(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield cut
    for name, value in zip(names, old, strict=True):
        spark.conf.set(name, value)


def whole(spark, path):
    """The multi-line reader, one task a file."""
    reader = spark.read.schema(NOTES).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.option("dateFormat", "yyyy-MM-dd").option("maxCharsPerColumn", -1).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(path)


def note(draw, i):
    text = "".join(draw.choice(['""', "\n", ",", "a", "é", " ", '"",', ',""\n', "\n\n", "word "]) for _ in range(draw.randint(0, 20)))
    quoted = f'"{text}"' if draw.random() < 0.9 else draw.choice(["plain", 'in"ner', "", '"end"'])
    return f'p{i},2007-01-{1 + i % 28:02d},{i:03d},{draw.choice(["0", "1"])},Car,2006-12-{1 + i % 28:02d},{quoted}'


@pytest.mark.parametrize("size", [61, 150, 10_000])
def test_notes_read_in_slices_equal_the_whole_files(spark, tmp_path, tiny_slices, size):
    draw = random.Random(size)
    for name in ("b.csv", "sub/a.csv", "sub/empty.csv"):
        lines = [note(draw, i) for i in range(20 if "empty" not in name else 0)]
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text("\n".join([HEADER, *lines]) + draw.choice(["", "\n", "\n\n"]), encoding="utf-8", newline="")
    (tmp_path / "other.txt").write_text("x,y\n1,2\n")
    want = sorted(map(tuple, whole(spark, str(tmp_path)).collect()), key=repr)
    tiny_slices(size)
    got = R.read_notes(spark, str(tmp_path))
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == want and len(want) == 40
    ids = {r["note_id"]: (r["p_id"], r["text"]) for r in got.collect()}
    tiny_slices(1 << 27)
    assert ids == {r["note_id"]: (r["p_id"], r["text"]) for r in R.read_notes(spark, str(tmp_path)).collect()}
    for number, (p_id, _) in ids.items():
        raw = (tmp_path / ("b.csv" if number >> records.FILE_BITS == 0 else "sub/a.csv")).read_bytes()
        assert raw[number & ((1 << records.FILE_BITS) - 1) :].startswith(p_id.encode() + b",")


def test_one_note_over_many_slices_and_windows_line_ends(spark, tmp_path, tiny_slices):
    text = "line of a note\r\n" * 60
    body = f'{HEADER}\r\np1,2007-01-01,001,0,Car,2006-12-01,"{text}"\r\np2,2007-01-01,002,0,Car,2006-12-01,b\r\n'
    (tmp_path / "n.csv").write_text(body, newline="")
    tiny_slices(50)
    got = R.read_notes(spark, str(tmp_path)).collect()
    assert sorted((r["p_id"], r["text"]) for r in got) == [("p1", text), ("p2", "b")]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, tiny_slices):
    (tmp_path / "n.csv").write_text(HEADER + "\n" + "\n".join(note(random.Random(i), i) for i in range(400)))
    tiny_slices(4000)
    assert records._lines(spark, str(tmp_path), "*.csv").rdd.getNumPartitions() > 8


@pytest.mark.parametrize("quoted", [False, True])
def test_quote_state_of_a_line(quoted):
    draw = random.Random(3)
    for _ in range(3000):
        line = "".join(draw.choice('",a\t') for _ in range(draw.randint(0, 12)))
        state, at, start = quoted, 0, not quoted
        while at < len(line):  # sign by sign
            c = line[at]
            if state and c == '"' and line[at + 1 : at + 2] == '"':
                at += 1
            elif state and c == '"':
                state = False
            elif not state and c == '"' and start:
                state = True
            start = not state and c == ","
            at += 1
        assert records.quoted_after(line.encode(), quoted) == state, line


def test_wide_files_by_one_scan(spark, tmp_path):
    draw = random.Random(4)
    want = set()
    for f in range(200):
        names = [f'c{draw.randint(0, 50)}_{i}' for i in range(draw.randint(1, 6))] + (['odd, "name"'] if f % 9 == 0 else [])
        place = draw.randint(0, len(names))
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if f % 7 == 0 else "\n")
        writer.writerow([*names[:place], "Empi_IndexDt" if f % 2 else "empi_indexdt", *names[place:]])
        for row in range(3):
            cells = [draw.choice(["", "NA", "0", "2", "3.0"]) for _ in names]
            writer.writerow([*cells[:place], f"0{row}17167", *cells[place:]])
            want |= {(f"0{row}17167", n, int(float(c)), f"f{f}.csv") for n, c in zip(names, cells, strict=True) if c not in ("", "NA")}
        (tmp_path / f"f{f}.csv").write_text(out.getvalue(), newline="")
    frame = R.read_code_frequencies(spark, [str(tmp_path / f"f{f}.csv") for f in range(200)])
    got = [tuple(r) for r in frame.select("empi_indexdt", "code", "n", "source").collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1
    empi, expdate = K.split_empi_indexdt(F.col("empi_indexdt"))
    assert {str(r[0]) for r in frame.select(empi).distinct().collect()} == {"00", "01", "02"}
    assert {str(r[0]) for r in frame.select(expdate).distinct().collect()} == {"2007-01-01"}
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="bad.csv"):
        R.read_code_frequencies(spark, [str(tmp_path / "bad.csv"), str(tmp_path / "f1.csv")])


def test_column_blocks(spark, tmp_path):
    draw = random.Random(5)
    names = [f"w{i}" for i in range(25)] + ['odd "word", two']
    rows = [(f"k{k}", n, float(draw.randint(0, 9))) for k in range(30) for n in names if draw.random() < 0.3]
    features = spark.createDataFrame(rows, "empi_indexdt string, feature string, value double")
    ranks = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank long")
    wide.write_blocks(features, ranks, str(tmp_path / "m"), "unigram", width=4, parts=3)
    got = R.read_ngram_shards(spark, [str(tmp_path / "m")]).collect()
    place = {n: i for i, n in enumerate(names)}
    assert sorted(map(tuple, got)) == sorted((k, n, v, f"unigram_{place[n] // 4 + 1}.csv") for k, n, v in rows)
    files = list((tmp_path / "m").glob("source=*/part=*/*.txt"))
    assert len({f.parent for f in files}) == len(files) > 7
    assert all(f.read_text().startswith("empi_indexdt,") for f in files)


def test_only_the_chosen_cohort_files_are_opened(spark, tmp_path):
    for name in ("mcr_statin", "max_statin", "mcr_other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(f"empi,expdate,n\n007,2007-01-01,{len(name)}\n")
    frame = R.read_cohort(spark, str(tmp_path / "*"), "statin", "mcr")
    assert [f.rsplit("/", 2)[1] for f in frame.inputFiles()] == ["mcr_statin"]
    assert [tuple(r)[::2] for r in frame.collect()] == [("007", 10)]
    with pytest.raises(ValueError, match="no file"):
        R.read_cohort(spark, str(tmp_path), "absent", "mcr")


def test_results_are_reused_for_the_same_input_only(spark, tmp_path):
    path = str(tmp_path / "r")
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i long, t string")
    made = []

    def build():
        made.append(1)
        return frame.limit(len(made))

    for given, settings, count in (
        (frame, {"k": 1}, 1),
        (frame.repartition(7).orderBy("t"), {"k": 1}, 1),
        (frame, {"k": 2}, 2),
        (frame.where("i > 0"), {"k": 2}, 3),
        (frame.unionByName(frame.where("i = 3")), {"k": 2}, 4),
        (frame.withColumn("t", F.lit(None).cast("string")), {"k": 2}, 5),
    ):
        assert W.reused(spark, path, build, [given], settings).count() == count
    assert W.reused(spark, path, build).count() == 5  # without inputs a finished table is enough


def test_learned_abbreviations_do_not_end_a_sentence(spark):
    # Every word that ends a sentence is seen elsewhere without a full stop.
    text = " ".join(["Seen by dr. house today. The dose of approx. 5 mg was given. Today he is given house food. The food was seen."] * 3)
    frame = spark.createDataFrame([(i, text) for i in range(60)] + [(99, None), (98, ""), (97, "No. stop")], "note_id long, text string")
    known = SE.abbreviations(frame.where("note_id < 60"))
    words = {r["word"]: r["score"] for r in known.collect()}
    assert {"dr", "approx"} <= words.keys() and not {"today", "given", "food", "seen"} & words.keys()
    got = [r["document"] for r in SE.split(frame, known).where("note_id = 1").orderBy("position").collect()]
    assert got[:2] == ["Seen by dr. house today.", "The dose of approx. 5 mg was given."] and len(got) == 12
    rest = {(r["note_id"], r["document"]) for r in SE.split(frame, known).where("note_id > 60").collect()}
    assert rest == {(97, "No."), (97, "stop")}
