"""Operators 1 and 3 against plain Python."""
from collections import Counter

from adloom.llm.queries import URL_RULES
from adloom.llm.quality_rules import EDGE, STOP_WORDS, quality_rules
from adloom.llm.url_filter import url_filter, write_index

from .conftest import WORDS


def bare(word):
    return "".join(c.lower() if c.isascii() else c for c in word).strip(EDGE)


def expected(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    n, dup, chars = len(w), len(lines) - len(set(lines)), sum(map(len, w))
    symbols, bangs = sum(c in "#*$%&|<>" for c in t), t.count("!")
    failed = n < 50 or 100 * len(cover) > 50 * n
    one = max(n, 1)
    kept = (not failed and 2 <= chars / one <= 12 and symbols / one <= 0.1 and bangs / one <= 0.3
            and sum(bare(x) in STOP_WORDS for x in w) / one >= 0.02 and dup / max(len(lines), 1) <= 0.5)
    return n, chars, symbols, dup, len(cover), failed, kept


def test_quality_rules_match_plain_python(make_docs, odd_texts):
    rows = quality_rules(make_docs(odd_texts)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows}
    assert got == {i: expected(t) for i, t in enumerate(odd_texts)}


def test_many_repeated_windows(make_docs):
    text = " ".join(f"w{i % 150}" for i in range(2000))       # more than 64 windows twice
    row = quality_rules(make_docs([text])).first()
    assert row.n_repeat_words == expected(text)[4] == 2000


def test_stop_words_count_by_share_in_any_case_and_punctuation(make_docs):
    plain = [f"word{i}" for i in range(200)]
    texts = [" ".join(plain + stops) for stops in (["The", "OF,", "(and)", "To."], ["the", "of", "and", "to", "in"], ["\u2019the"] * 5,
                                                    ["\u212a"] * 9, ["the"])]
    texts += [" ".join(plain[:n] + ["the"]) for n in (49, 50)]
    rows = {r.doc_id: r for r in quality_rules(make_docs(texts)).collect()}
    assert {i: rows[i].kept for i in rows} == {i: expected(t)[6] for i, t in enumerate(texts)}
    assert rows[1].kept and rows[5].kept and not rows[2].kept and not rows[4].kept and not rows[6].kept


def test_quality_rules_of_an_empty_table(make_docs):
    assert quality_rules(make_docs(["x"]).limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://", "https://Example.NET/en/x?q", "http://a.example.net/EN/", "ftp://x.net", "http://x.net/",
        "http://net/", "http://notnet/", "http://xnet/", "https://www.example.com/de/a#b", "http://example.com/fr/", "http://a.b.org/fr/?x",
        "http://x.org/fr", "http://x.net:80/", "http://a..net/x", "http://É.net/", "http://u@example.net/en/", "a://b://c.net/"]


def judge(url):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter_matches_plain_python(llm_spark):
    pages = llm_spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    for per_file in (1_000_000, 1):                            # one index file, and one for each rule
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, URL_RULES, per_file).collect()}
        assert got == {i: judge(u) for i, u in enumerate(URLS)}
    assert url_filter(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter(pages, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    from adloom.llm import url_filter as U
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda b: 7)
    names = write_index([("block", "a", "/"), ("allow", "b", "/")], str(tmp_path))
    index = U.DigestIndex(str(tmp_path / names[0]))
    rules, verdicts = U.best_rules(["a", "b", "c"], ["/", "/x", "/"], [index], [1])
    assert (rules, verdicts) == (["a/", "b/", None], ["block", "allow", None])
