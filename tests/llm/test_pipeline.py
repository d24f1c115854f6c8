"""The pipeline on a small corpus: each stage against brute force on its own input, and the whole on odd tables."""

import hashlib
import random
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lodestone.llm.bpe import load_ranks
from lodestone.llm.common import staged

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("river", "stone", "walk", "green", "light", "paper") for b in ("s", "ing", "er", "ed", "ly", "y", "ful", "less")]


def corpus(seed=3):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = ["\n".join(prose(rng.randrange(4, 30)) for _ in range(rng.randrange(2, 8))) for _ in range(40)]
    items = [prose(9), prose(30), "two words", None]
    long = prose(60)
    texts += [f"{prose(9)}\n{long}\n{prose(8)}", f"{prose(7)}\n{long}\n{prose(6)}"]
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " " + prose(1), texts[3] + "\n" + items[0], prose(500) + " " + items[1] + " " + prose(500), "a\nb c\n" + texts[4]]
    texts += [" ".join(w.upper() + "%%|" for w in prose(80).split()) for _ in range(20)]
    texts += [None, "", " \n", prose(30_000)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not (t or "").endswith("%%|")), 0) for i, t in enumerate(texts)]
    return docs, labels, items


def shingles(text, size=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_lines(rows):
    """Runs of two or more lines, and lines of 50 or more words, that occur before, in the order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        every = (text or "").split("\n")
        own = [k for k, x in enumerate(every) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for o in range(len(own)):
            for n in range(1, len(own) - o + 1):
                run = tuple(every[k] for k in own[o : o + n])
                if n > 1 or len(run[0].split()) >= 50:
                    if run in seen:
                        gone.update(own[o : o + n])
                    seen.add(run)
        out[i] = None if text is None else "" if gone and len(gone) == len(own) else "\n".join(x for k, x in enumerate(every) if k not in gone)
    return out


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and (a == b or (a and b and len(a & b) >= 0.8 * len(a | b))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in sets}


def brute_leaks(rows, items):
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    out = set()
    for i, t in rows:
        for item in items:
            s = {" ".join(x) for x in shingles(words(item))}
            if s and sum(f" {x} " in f" {words(t)} " for x in s) >= 0.8 * len(s):
                out.add(i)
    return out


def write(spark, root, docs, labels, items, columns=COLUMNS):
    spark.createDataFrame(docs, columns).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def test_stages_like_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    write(spark, tmp_path, docs, labels, items)
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    before = {r.doc_id: r.text for r in held.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = staged(stage(spark, held, str(tmp_path)), name)
        rows = {r.doc_id: r for r in made.collect()}
        if name != "bpe":
            assert made.columns == held.columns
        if name == "quality":
            assert {i for i in before if (before[i] or "").endswith("%%|")} == before.keys() - rows.keys() - {i for i in before if not (before[i] or "").strip()}
        elif name == "line_dedup":
            want = brute_lines(before.items())
            assert {i: r.text for i, r in rows.items()} == want and any(want[i] != before[i] for i in want)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows.values())
        elif name == "near_dedup":
            assert rows.keys() == brute_near(before.items()) and len(rows) < len(before)
        elif name == "decontamination":
            gone = brute_leaks(before.items(), items)
            assert gone and rows.keys() == before.keys() - gone
        else:
            assert made.columns == [*(c for c in held.columns if c != "text"), "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            for i, r in rows.items():
                assert r.ids == ",".join(map(str, library.encode_ordinary(before[i] or ""))) and r.n_tokens == len(r.ids.split(",")) * bool(r.ids)
                assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((before[i] or "").encode()).hexdigest()
            assert rows.keys() == before.keys()
        held, before = made, {i: r["text"] if name != "bpe" else None for i, r in rows.items()}


def test_run_with_nulls_clashes_and_repeated_rows(spark, tmp_path):
    docs, labels, items = corpus(4)
    odd = [(None, "a text that has no id but some words", "x", "s", 1), (None, None, None, None, None), docs[5], docs[5], (7, "an unrelated text under an id that another row has, too", None, "s", 3)]
    mine = [(*d, "mine", "mine", i) for i, d in enumerate([*docs[:10], *docs[48:58], *odd])]
    write(spark, tmp_path / "a", mine, labels, items, COLUMNS + ", n_tokens string, N_Lines string, __rid int")
    rows = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert all(r.N_Lines == "mine" and isinstance(r.n_tokens, int) for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 7 for r in rows) == 2 and sum(r.doc_id == 5 and r.n_tokens > 0 for r in rows) == 1
    write(spark, tmp_path / "b", docs[:0], labels[:0], items[:0])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
