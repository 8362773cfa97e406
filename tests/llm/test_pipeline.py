import random
import re

import corpus_pipeline
from tidewater.llm import ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def tables(tmp, spark, rows, labels, items):
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp}/{name}.parquet")
    return str(tmp)


def test_run_matches_what_was_planted(spark, tmp_path):
    r = random.Random(21)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(n))
    rows, labels = [], []
    add = lambda i, t, s="web": rows.append((i, t, "en", s, len(t or ""), "x"))
    for i in range(200):
        t = "\n".join(prose(20) for _ in range(3))
        if i % 5 == 0:
            t = t.replace(" ", " zidiotz ", 2).replace(" ", " zscumz ", 1)
        add(i, t, "web" if i % 3 else "books")
        labels.append((i, 1, int(i % 5 == 0)))
    toxic = {i for i in range(200) if i % 5 == 0}
    whole = dict((x[0], x[1]) for x in rows)
    add(300, whole[1])  # an exact copy: all of its lines repeat, so nothing is left
    add(301, whole[2].replace("\n", " ") + " more")  # a near copy as one line: no line repeats, its shingles do
    shared = whole[3].split("\n")[1]
    add(302, f"{prose(30)}\n{shared}\n{prose(30)}")  # loses one line
    item = prose(40)
    add(303, f"{prose(30)} {item} {prose(30)}")  # holds a benchmark item
    for i, t in ((304, None), (305, ""), (306, " \n "), (307, "one")):
        add(i, t)
    d = tables(tmp_path, spark, rows, labels, [(1, item), (2, None), (3, "")])
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, d).collect()}
    assert set(out) == {x[0] for x in rows} - toxic - {300, 301, 303}
    assert shared not in out[302]["text"] and out[302]["text"].count("\n") == 1
    assert all(out[i]["text"] == whole[i] for i in set(out) & set(whole))
    # Brute force over the result: no two documents link, no line stands twice, and the budget is kept.
    kept = [x["text"] for x in out.values() if words(x["text"])]
    sets = [shingles(t) for t in kept]
    assert not any(len(a & b) * 100 >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    lines = [tuple(sorted(set(words(x)))) for t in kept for x in t.split("\n") if words(x)]
    assert len(lines) == len(set(lines))
    assert sum(x["mix_n_tokens"] * x["mix_copies"] for x in out.values()) <= sum(x["mix_n_tokens"] for x in out.values())
    assert {n for n, _ in corpus_pipeline.STAGES} == {"toxicity", "line_dedup", "ngram_join", "decontaminate", "mixing"}


def test_empty_tables_and_columns(spark, tmp_path):
    d = tables(tmp_path, spark, [], [], [])
    out = corpus_pipeline.run(spark, d)
    assert out.count() == 0 and "text" in out.columns and "cls" in out.columns
    assert ngram_join.one_of_each(spark.createDataFrame([], DOCS)).count() == 0
