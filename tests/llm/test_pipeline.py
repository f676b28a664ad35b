"""The pipeline against its stages written plainly."""

import os
import unicodedata
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from cellatlas.llm import langid, packing, pii, quality
from cellatlas.llm.bpe import byte_characters
from cellatlas.llm.common import checkpoint_root
from cellatlas.llm.labelled import sample
from llm.conftest import SF
from llm.test_neardup import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
        if name != "packing":
            assert out[-1].columns == docs.columns
    text = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in out[:5]]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.op10_quality(spark, SF).collect()}
    assert text[1] == {i: t for i, t in text[0].items() if verdicts[i]}
    model = langid.Languages(langid.fit(sample(out[1].filter(~langid.held_out()), "lang", "text", langid.ROWS, langid.LANGUAGES)))
    assert text[2] == {i: t for i, t in text[1].items() if model.guess(t).accepted}
    parts = brute(list(text[2].items()), 80)
    assert text[3] == {i: t for i, t in text[2].items() if parts[i][1] == i}
    assert text[4] == {i: pii.masked(t, pii.spans(t)) for i, t in text[3].items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out[5].collect():
        assert len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["ids"]))
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    for i, x in text[4].items():
        assert [k for _, own in sorted(pieces[i]) for k in own] == [*t.encode(x, add_special_tokens=False).ids, packing.END]
    # each sequence, cut at the ends of documents, decodes to parts of the masked texts
    plain = lambda ids: b"".join(bytes(map(byte.__getitem__, t.id_to_token(k).removesuffix("</w>"))) for k in ids)
    byte = {c: b for b, c in enumerate(byte_characters())}
    squeezed = lambda x: "".join(unicodedata.normalize("NFC", x).lower().split()).encode()
    assert set(pieces) == set(text[4])
    whole = {i: plain(k for _, own in sorted(pieces[i]) for k in own[:-1] if True) if len(pieces[i]) == 1 else None for i in pieces}
    for i, x in whole.items():
        assert x is None or x == squeezed(text[4][i])
    assert all(sum(len(x) for _, x in own) <= packing.LENGTH for own in sequences.values())


def test_run(spark):
    """The result of the run is whole, its stages are there by name, and nothing else is left."""
    before = set(os.listdir(checkpoint_root(spark).removeprefix("file://")))
    found = C.run_stages(spark, SF)
    assert list(found) == [name for name, _ in C.STAGES]
    left = set(os.listdir(checkpoint_root(spark).removeprefix("file://"))) - before
    assert sorted(x.rsplit("-", 1)[0] for x in left) == sorted(["quality", "language", "near_duplicates", "personal_data", "tokens"])
    rows = found["packing"].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in found["personal_data"].collect()}
    assert len(rows) == C.run(spark, SF).count() > 50


def test_own_columns_pass(spark, odd):
    out = odd
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == odd.columns, name
    assert C.STAGES[-1][1](spark, odd, "").count() >= odd.count()
