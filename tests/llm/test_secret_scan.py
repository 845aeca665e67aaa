"""Secret scan against plain Python over finditer() and counted windows."""

import re
from collections import Counter

import numpy as np

from quillmark.llm import secret_scan as S


def plain(text):
    """(start, kind number, end) of base spans, and of all."""
    text = text or ""
    base = []
    for no, (pattern, group, least) in enumerate(S.BASE.values()):
        base += [(m.start(), no, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        c = m.group()
        if not re.search(S.PUT_TOGETHER, c) or any(re.search(p, c) for p in S.ALLOWED):
            continue
        last = None
        for j in range(len(c) - S.WINDOW + 1):
            w = c[j : j + S.WINDOW]
            two = re.search("[A-Za-z]", w) and re.search("[0-9]", w)
            name = "hexadecimal" if two and re.fullmatch("[0-9A-Fa-f]+", w) else "mixed" if two else "letters" if re.search("[a-z]", w) and re.search("[A-Z]", w) else None
            if name and sum(S.TERMS[n] for n in Counter(w).values()) <= S.MOST[name]:
                if last and j <= last[1]:
                    last[1] = j + S.WINDOW
                else:
                    last = [j, j + S.WINDOW]
                    more.append((m.start(), last))
    return sorted(base), sorted(base + [(at + a, 3, at + b) for at, (a, b) in more])


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x)[:3] for x in r["base"]], [tuple(x)[:3] for x in r["spans"]]) for r in S.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t[:200]
    return got


def test_random_texts_give_the_spans_of_plain_windows(spark):
    rng = np.random.default_rng(7)
    pieces = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", ": ", "=", ' = "', "'", "AKIA", "é", "\U0001f600", " ", "\n", "/", "-", "=="]
    alphabets = ["0123456789abcdef", "0123456789ABCDEFabcdef", S.ALPHABET, "abcdefghijklmnopqrstuvwxyz", "ABCab", "0123456789"]
    texts = []
    for _ in range(250):
        t = ""
        for _ in range(int(rng.integers(1, 14))):
            t += pieces[rng.integers(len(pieces))] if rng.random() < 0.6 else "".join(rng.choice(list(alphabets[rng.integers(len(alphabets))]), int(rng.integers(1, 70))))
        texts.append(t)
    got = check(spark, texts)
    assert sum(s[1] == 3 for _, spans in got.values() for s in spans) > 100


def test_hand_written_cases(spark):
    key = "aB3xK9pQ7zL2mN8vR4tY6wE1"
    texts = [
        f"see {key} here",
        f"sha256-{key} {key}EXAMPLE 123e4567-e89b-12d3-a456-426614174000 a/path/of-words/and_2024/more",
        "token: short, token = longenough; passwordtoken=abcdefgh token:token:abcdefghij",
        "AKIA1234 AKIAAKIAAKIAAKIA AKIA",
        "0123456789abcdef" * 2 + " " + "0123456789ABCDEF" * 2 + " 4915112345678901234567890",
        "y" * 40 + " DonaudampfschifffahrtsGesellschaft Unternehmensverantwortung",
        'api-key="abcdefgh" apikey:\'abcdefgh\' API_KEY  =  abcdefgh ſecret=abcdefgh',
    ]
    got = check(spark, texts)
    assert [s[1] for s in got[0][1]] == [3] and got[1][1] == [] and got[5][1] == []


def test_very_long_texts_are_scanned_whole(spark):
    rng = np.random.default_rng(1)
    key = lambda n: "".join(rng.choice(list(S.ALPHABET[:62]), n))
    check(spark, ["word " * 60_000 + "token=abcdefgh1 " * 900 + key(30), key(6_000) + "/" + "a" * 3_000 + key(40)])


def test_odd_rows(spark, odd, none):
    r = S.scan(odd).collect()
    assert len(r) == odd.count() and all(x["spans"] == [] for x in r)
    assert S.scan(none).collect() == [] and S.redacted(none).collect() == []


def test_redaction_replaces_unions_of_spans_only(spark):
    key = "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, f'é token = "{key}" end'), (2, "plain"), (3, None), (None, f"{key}|{key}"), (1, f'é token = "{key}" end')], "doc_id long, text string")
    got = [tuple(r) for r in S.redacted(docs).collect()]
    assert got == [(1, 'é [secret]" end'), (2, "plain"), (3, None), (None, "[secret]|[secret]"), (1, 'é [secret]" end')]
