import random
import re
from collections import Counter, defaultdict

from tiermill.llm.line_frequency import Limits, assess, clean, line_hash, repeated_words
from tiermill.llm.queries import op2_line_frequency

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_whole_table_against_plain_counts(spark, folder, texts):
    got = {r.doc_id: r for r in op2_line_frequency(spark, folder).collect()}
    docs = texts.collect()
    assert len(got) == len(docs)
    for d in docs:
        own = counts(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r.kept and r.base_failed)


def test_frequent_lines_by_brute_force(spark):
    rows = [(i, f"own line {chr(97 + i % 26)}{chr(97 + i // 26)} of this document only\nShared  Footer {i}\nmore text {'x' * i}", "h") for i in range(30)]
    rows += [(100 + i, "a copied text with a few words\nand its second line\nshared footer 7", "h") for i in range(50)]
    rows += [(200 + i, "shared footer 1\nshared footer 2", "h") for i in range(3)]
    rows += [(300, "shared footer 5\nhere it is rare and so it stays where it is now", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in assess(docs).collect()}
    # The copies count once, so only the footer is frequent; digits do not tell lines apart.
    assert all(got[i].removed_lines == 1 and got[i].removed_words == 3 and got[i].kept for i in range(30))
    assert all(got[100 + i].removed_words == 3 and got[100 + i].kept for i in range(50))
    assert got[200].removed_words == 6 and not got[200].kept and got[300].removed_words == 0 and got[300].kept
    cleaned = {r.doc_id: r.text for r in clean(docs).collect()}
    assert set(cleaned) == {k for k, r in got.items() if r.kept}
    assert cleaned[100] == "a copied text with a few words\nand its second line" and cleaned[300] == rows[-1][1]


def letters(draw):
    """A word; digits would not tell lines apart."""
    return "".join(draw.choice("abcdefghijklmnop") for _ in range(6))


def test_verdicts_by_brute_force(spark):
    """Pages of hosts with menus, notices of one word, copies and near copies: lines counted over told documents in plain code."""
    draw = random.Random(6)
    rows = []
    for host in ("a", "b", None):
        menu = [" ".join(f"{host}{chr(97 + i)}{chr(97 + j)}" for j in range(draw.randrange(1, 4))) for i in range(9)]
        for i in range(60):
            own = [" ".join(letters(draw) for _ in range(12)) for _ in range(3)]
            rows.append((len(rows), "\n".join([*menu, *own, "Sign in"] if host != "b" else own + draw.sample(menu, 3)), host))
        base = [" ".join(letters(draw) for _ in range(12)) for _ in range(20)]
        for i in range(40):
            rows.append((len(rows), "\n".join([*base[:19], f"edited {letters(draw)}" if i % 2 else base[19]]), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    limits = Limits()
    lines = {i: {line_hash(x.encode().split()): len(x.split()) for x in t.split("\n")} for i, t, _ in rows}
    raw = Counter((h, x) for i, _, h in rows for x in lines[i])
    told = defaultdict(set)
    for i, _, h in rows:
        rare = [x for x in lines[i] if raw[h, x] <= 20]
        enough = sum(lines[i][x] for x in rare) >= 0.2 * sum(lines[i].values())
        for x in lines[i]:
            told[h, x].add(("rare", min(rare), max(rare)) if enough else ("all", min(lines[i]), max(lines[i])))
    got = {r.doc_id: r for r in assess(docs, limits=limits).collect()}
    for i, _, h in rows:
        gone = [x for x in lines[i] if len(told[h, x]) > 20]
        removed = sum(lines[i][x] for x in gone)
        assert (got[i].removed_words, got[i].removed_lines) == (removed, len(gone))
        assert got[i].kept == (2 * removed <= got[i].n_words)
    # All ten shared lines of the first host are found, and its copies keep everything.
    assert all(got[i].removed_lines == 10 for i in range(60)) and all(got[i].removed_lines == 0 for i in range(60, 100))


def test_odd_rows(odd, none):
    rows = assess(odd, limits=Limits(line_docs=0)).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(by[i][0].base_failed and not by[i][0].kept and by[i][0].n_words == 0 for i in (1, 2, 3))
    assert len(by[4]) == 2 and by[4][0] == by[4][1] and by[7][0].n_repeat_words == 300
    cleaned = clean(odd)
    assert cleaned.columns == odd.columns and [r.doc_id for r in cleaned.collect()].count(4) == 2
    assert assess(none).collect() == [] and clean(none).collect() == []


def test_long_text_with_many_distinct_words():
    words = [str(i % 7000).encode() for i in range(7000)] + [b"a", b"b", b"c", b"d", b"e", b"z", b"a", b"b", b"c", b"d", b"e"]
    assert repeated_words(words, 5) == 10 == counts(" ".join(w.decode() for w in words))[4]
