import pandas as pd
import pytest

from loomspark.operators import text


def test_chunks_of_many_texts_are_handed_on_together(spark, monkeypatch):
    made, docs = [], [(k, f"# T{k}\n\n" + "word. " * (k % 7 * 40)) for k in range(60)] + [(60, None), (61, "  ")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = sorted(map(tuple, text.split_documents(table, 64, "recursive").collect()))
    assert whole == sorted((f"{d}_chunk_{k}", d, "recursive", k, p) for d, t in docs for k, p in enumerate(p for p in text.SPLITTERS["recursive"](t or "", 64) if p.strip()))
    # the function that tasks run, called here: frames are as few as rows and characters allow
    spied = {}
    monkeypatch.setattr(type(table), "mapInPandas", lambda self, run, schema: spied.setdefault("run", run))
    text.split_documents(table, 64, "recursive")
    batch = pd.DataFrame([(d, t, "recursive") for d, t in docs], columns=["id", "text", "how"])
    frames = list(spied["run"](iter([batch, batch])))
    assert len(frames) == 1 and len(frames[0]) == 2 * len(whole)


@pytest.mark.parametrize("limit", [("HELD_ROWS", 5), ("HELD_CHARS", 100)])
def test_frames_stay_small(spark, monkeypatch, limit):
    monkeypatch.setattr(text, *limit)
    table, spied = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), {}
    monkeypatch.setattr(type(table), "mapInPandas", lambda self, run, schema: spied.setdefault("run", run))
    text.split_documents(table, 64, "recursive")
    batch = pd.DataFrame([(k, "word. " * 10, "recursive") for k in range(20)], columns=["id", "text", "how"])
    frames = list(spied["run"](iter([batch])))
    assert len(frames) > 2 and sum(map(len, frames)) == 20
