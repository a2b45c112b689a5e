import math
import random
import re
from collections import Counter, defaultdict

from storyloom.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def js(p, q):
    kl = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in a if x > 0)
    return math.sqrt(max(0, (kl(zip(p, q, strict=True)) + kl(zip(q, p, strict=True))) / 2))


def texts():
    rng = random.Random(9)
    out = [None, "", " \n\t ", "a", "a b c", "a b c d a b c", "x " * 99, "é ü\x0bß\x0cq\rz ** <|>\n" * 3, "long " * 20000]
    vocab = ["the", "of", "und", "a", "b", "ééé", "##", "x|y", "12"]
    for _ in range(120):
        words = [rng.choice(vocab) + str(rng.randint(0, rng.choice([0, 3, 500]))) * rng.randint(0, 1) for _ in range(rng.randint(1, 150))]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\n\n"]) for w in words))
    return out


def test_counts_against_plain_python(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[5], (None, "a b", None)], "doc_id long, text string, lang string").selectExpr("*", "1 words", "2 chars")
    got = Q.judge(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(rows[r.doc_id][1])
        assert not (r.base_failed and r.kept)


def test_distances_against_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        words = [rng.choice([*Q.COMMON[lang][:8], "Haus", "tree7", "run.", "xyzzy,"]) + str(rng.randint(0, 9)) * (rng.random() < 0.3) for _ in range(130)]
        rows.append((i, " ".join(words), lang))
    rows.append((60, " ".join(f"Q{i}&&&" for i in range(300)), "en"))
    rows.append((61, rows[0][1], "xx"))
    shares, by = {}, defaultdict(list)
    for i, t, lang in rows:
        chars = [sum(map(len, re.findall(p, t))) for p in (r"[a-zß-ü]", r"\s", r"[A-Z]", r"\d", r"[.,;:!?'\"()\-]")]
        chars.append(len(t) - sum(chars))
        w = [x.lower().rstrip(".,;:!?") for x in t.split()]
        common = [w.count(c) for c in Q.COMMON[lang]] if lang in Q.COMMON else None
        shares[i] = [x / len(t) for x in chars], common and [x / len(w) for x in [*common, len(w) - sum(common)]]
        if common and not plain(t)[5]:
            by[lang].append(shares[i])
    mean = {k: [[sum(x) / len(v) for x in zip(*(s[j] for s in v), strict=True)] for j in (0, 1)] for k, v in by.items()}
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in rows[:61]:
        assert abs(got[i].char_distance - js(shares[i][0], mean[lang][0])) < 1e-9
        assert abs(got[i].word_distance - js(shares[i][1], mean[lang][1])) < 1e-9
    # the one document of a language without a word list is like itself, by its character classes alone
    assert got[61].char_distance == 0.0 and got[61].word_distance is None and got[61].kept == (not got[61].base_failed)
    assert not got[60].kept


def test_clean_documents_stay_and_no_python_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = Q.judge(docs)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    good = [r for r in found.collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert len(good) > 100 and all(r.kept for r in good)


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_bad_documents_that_pass_the_base_rules(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in Q.judge(spark.read.parquet(f"{d}/documents.parquet")).collect() if not r.base_failed and r.doc_id in labels]
    bad, good = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (0, 1))
    assert sum(good) >= 0.99 * len(good) and len(bad) > 20 and sum(bad) <= 0.25 * len(bad)


def test_languages_without_a_word_list_are_judged_by_characters(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["la", "città", "nuova", "strada", "Roma,", "sempre.", "che", "vento"]) + rng.choice(["", "a", "i"]) for _ in range(90)) for _ in range(40)]
    bad = [" ".join("".join(rng.choice("@^~=_/\\{}") for _ in range(rng.randint(2, 9))) for _ in range(90)) for _ in range(3)]
    rows = [(i, t, "it") for i, t in enumerate([*good, *bad])] + [(99, bad[0], None)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(40)) and all(got[i].word_distance is None for i in range(43))
    assert not any(got[i].base_failed or got[i].kept for i in range(40, 43))
    assert got[99].char_distance is None and got[99].kept
