"""The registered queries on the smallest tables, and the pipeline's stages one by one."""

import json
import zlib

import brute
import numpy as np
import oracle
import pandas as pd
import pytest

import corpus_pipeline
from larder.llm import html_text, packing
from larder.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    assert oracle.differences(QUERIES[name](spark, small), oracle.connect(small), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, small, name):
    table = {"op2": "pages", "op3": "pages"}.get(name.split("_")[0], "documents")
    key = "page_id" if table == "pages" else "conv_id" if name.startswith(("op9", "op11")) else "doc_id"
    got = {r[key] for r in QUERIES[name](spark, small).select(key).collect()}
    source = pd.read_parquet(f"{small}/{'conversations' if key == 'conv_id' else table}.parquet")
    want = set(source[key]) | ({-7} if name.startswith("op9") else set())
    assert got <= want if name.startswith("op5") else got == want


def test_op1_plain(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op1_substring_dedup"](spark, small).collect())
    assert got == sorted(brute.repeats(list(zip(docs.doc_id, docs.text))))


def test_op6_held_out(spark, small):
    got = QUERIES["op6_quality"](spark, small).toPandas()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == got.held_out.tolist()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, frames = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        frames.append(docs.toPandas())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    source = pd.read_parquet(f"{small}/documents.parquet")
    failed = {i for i, t in zip(source.doc_id, source.text) if brute.counts(t)[-1]}
    assert failed.isdisjoint(frames[0].doc_id) and len(frames[0]) > 0.8 * (len(source) - len(failed))
    assert frames[1].text.is_unique and set(frames[1].doc_id) <= set(frames[0].doc_id)
    items = [" ".join(t.split()) for t in pd.read_parquet(f"{small}/benchmark.parquet").text]
    assert not any(q in " ".join(t.split()) for t in frames[2].text for q in items)
    assert set(frames[3].doc_id) == set(frames[2].doc_id) and not any(brute.personal(t) for t in frames[3].text)
    assert (frames[3].n_chars == frames[3].text.str.len()).all()
    tokens = packing.Tokens.of(packing.tokenizer_path(), 1)
    ids = {i: tokens(t) for i, t in zip(frames[3].doc_id, frames[3].text)}
    last = frames[4]
    assert last.groupby("doc_id").length.sum().to_dict() == {i: len(x) // 4 for i, x in ids.items()}
    assert all(zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in last.itertuples())
    assert (last.groupby("sequence_id").length.sum() <= 4096).all()


def test_html_pages(small):
    """The extracted text is the article's, by a plain pattern that suffices for these pages."""
    import html
    import re

    for page in pd.read_parquet(f"{small}/pages.parquet").html:
        body = re.sub(r"(?s)^.*?<article>|</article>.*$", "", page)
        body = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\n", body)))
        assert html_text.main_text(page) == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\n")) if x)


def test_tokenizer_file_names_no_training():
    model = json.load(open(packing.tokenizer_path()))["model"]
    assert model["type"] == "BPE" and np.iinfo("<u4").max > len(model["vocab"])
