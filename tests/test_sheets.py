"""Workbooks: texts written a batch at a time, rows read in batches, and tasks that come too late."""

import inspect

import pyarrow as pa
import pytest
from pyspark.sql.types import StringType, StructField, StructType

from marketlens.sources import xlsx

ODD = ["", None, "a & b", "<x>", '"q" &amp;', "line\nend", "tab\t \x01\x1f end", "￾￿", "é日🙂", " lead"]


def source(path):
    return xlsx.XlsxSource({"path": str(path)})


def test_text_is_written_alike_by_row_and_by_batch():
    rows = [(ODD[i % 10], ODD[i * 7 % 10]) for i in range(xlsx.BATCH_ROWS + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["a", "b"])
    parts = list(xlsx._text_rows([batch.slice(0, 0), batch, batch.slice(3, 2)]))
    assert b"".join(x for _, x in parts) == b"".join(xlsx._row(k, r) for k, r in enumerate([*rows, *rows[3:5]], 1))
    assert [k for k, _ in parts] == [xlsx.BATCH_ROWS, len(rows), len(rows) + 2]


def test_rows_come_in_batches_and_whole(tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    n = xlsx.BATCH_ROWS + 7
    writer = source(tmp_path).writer(schema, False)
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{i}" for i in range(n)]), pa.array([ODD[2] if i % 3 else None for i in range(n)])], ["a", "b"])
    writer.commit([writer.write(iter([batch]))])
    (book,) = tmp_path.iterdir()
    reader = source(tmp_path).reader(StructType([*xlsx.PLACE, StructField("b", StringType()), StructField("gone", StringType()), StructField("a", StringType())]))
    parts = [list(reader.read(p)) for p in reader.partitions()]
    assert [len(b) for b in parts[0]] == [xlsx.BATCH_ROWS, 7]
    rows = [tuple(r.values()) for b in parts[0] for r in b.to_pylist()]
    assert rows == [(book.name, i, ODD[2] if i % 3 else "", "", f"r{i}") for i in range(n)]


@pytest.mark.parametrize("text", [False, True])
def test_a_task_that_ends_after_the_abort_leaves_nothing(tmp_path, text):
    schema = StructType([StructField("a", StringType())]) if text else StructType([StructField("a", StringType()), *xlsx.PLACE[1:]])
    writer = source(tmp_path / "out").writer(schema, False)
    writer.abort([])
    rows = iter([pa.RecordBatch.from_arrays([pa.array(["x"])], ["a"])]) if text and "RecordBatch" in inspect.getsource(xlsx) else iter([("x", 1)])
    with pytest.raises(FileNotFoundError):
        writer.write(rows)
    assert not list(tmp_path.rglob("*.xlsx"))
