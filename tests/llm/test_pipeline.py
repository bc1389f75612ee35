"""Each stage on the output of the one before, against brute force."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from evisynth.llm import mixing, quality, secrets  # noqa: E402
from evisynth.llm.common import table, written  # noqa: E402

from .test_operators import components, shingles  # noqa: E402


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1] if out else docs, sf), "stage"))
    good, unlike, masked, mixed, packed = out
    assert all(x.columns == docs.columns for x in out[:4])
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, kept = rows(docs), rows(good)
    judge = lambda t: (lambda p: not quality.base_failed(p) and not any(f(p) for f in quality.RULES.values()))(quality.Profile((t or "").encode()))
    assert kept == {i: t for i, t in before.items() if judge(t)}
    low = components({i: shingles(t) for i, t in kept.items()}, 80)
    assert rows(unlike) == {i: t for i, t in kept.items() if low[i] == i}
    found = secrets.found_secrets(unlike).where("size(secrets) > 0").count()
    assert masked.where("contains(text, '[SECRET]')").count() == found and masked.count() == unlike.count()
    assert found == 0 or secrets.found_secrets(masked).where("size(secrets) > 0").count() < found
    taken = mixing.mixed(masked).selectExpr("sum(taken)").head()[0]
    assert mixed.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").head()[0] == taken
    tok = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    total = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.select("text").collect())
    assert packed.selectExpr("sum(length)").head()[0] == total
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == sorted(r["doc_id"] for r in packed.select("doc_id").collect())
