import itertools
import re
from collections import Counter

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from meridia.llm import language_id, ngram_join
from meridia.llm.oracles import ORACLES

from .test_queries import corpus, written


def test_stages_keep_the_columns_and_take_effect(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
    assert now.count() > 0
    kept = spark.read.parquet(f"{tmp_path}/2")
    assert kept.count() == kept.select("text").distinct().count()
    assert {r.component_id for r in ngram_join.join_components(kept).collect()} == {r.doc_id for r in kept.collect()}
    assert all(any(c.isalpha() for c in r.text) for r in kept.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_first_stage_drops_only_what_is_rejected(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source")
    model = language_id.train(docs)
    found = language_id.predict_languages(docs, model)
    assert corpus_pipeline.identify_languages(spark, docs, "").count() == found.where("not rejected").count()


def near_components(rows: dict[int, str]) -> dict[int, int]:
    """Smallest id reachable by links of Jaccard 0.75 over five-word shingles, every pair compared."""

    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = {i: shingles(t) for i, t in rows.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def test_stages_match_plain_versions(spark, tmp_path):
    docs, labels = corpus()
    sf = written(spark, tmp_path, docs, labels)
    now, outs = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        outs.append(now.collect())
    identified, once, apart, mixed, encoded = outs

    of = {d[0]: d[1] for d in docs}
    kept = {r.doc_id: r.text for r in identified}
    assert len(kept) == len(identified) and all(of[i] == t for i, t in kept.items())
    assert set(range(120)) <= set(kept) and not set(kept) & {400, 401, 402}

    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    assert sorted(r.doc_id for r in once) == sorted(first.values())

    components = near_components({r.doc_id: r.text for r in once})
    assert sorted(r.doc_id for r in apart) == sorted(set(components.values()))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/stage2/*.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet/*.parquet'")
    copies = {i: int(taken / size + 0.5) for i, size, _, _, taken in con.execute(ORACLES["op2_mix_sources"]).fetchall() if size}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    assert all(of[r.doc_id] == r.text for r in mixed)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple(library.encode(r.text))) for r in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == want
