import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docreason.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    num = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(num(m.group())) <= 19 and luhn(num(m.group()))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(num(m.group())) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.train()


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@+-% 1203(é\n", max_size=60))
def test_base_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "+1 (499) 555-6503", "+49", "1.2.3.4", "256.1.1.1",
                                 "1.2.3.4.5.6.7.8", "a@b.c", "x.y@z", "@", "..", "-", " ", "9", "é", "+", "007.2.3.4"]), max_size=8))
def test_base_patterns_joined(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    text = "1" * 300_000 + " " + "a" * 300_000 + "@ " + "1." * 100_000 + "+" * 100_000 + "1 " * 100_000
    assert len(pii.base_spans(text)) == sum(1 for k, *_ in pii.base_spans(text))


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np
    rng = np.random.default_rng(0)
    sc = rng.normal(0, 3, (5, 3, pii.L))
    got = field.decode(sc)
    for r in range(5):
        def value(p):
            full = [0, *p, 0]
            return sum(field.trans[a, b] for a, b in zip(full, full[1:])) + sum(sc[r, t, y] for t, y in enumerate(p))
        best = max(itertools.product(range(pii.L), repeat=3), key=value)
        assert value(got[r]) == pytest.approx(value(best))


def test_field_learns_its_table_and_finds_more(field):
    right = total = 0
    for x, y in pii.labelled_runs():
        import numpy as np
        got = field.decode(field.scores(x)[None])[0]
        right += int((np.array(y) == got).sum())
        total += len(y)
    assert right / total > 0.97
    found = pii.all_spans(["please phone 555-0199 tomorrow", "my tel. (312) 555-0123, ok", "in 1990 we had 12 dogs, 2.5 each",
                           "no data here at all"], field)
    assert found == [[(3, 13, 21, False)], [(3, 8, 22, False)], [], []]


@pytest.mark.parametrize("text, spans", [
    ("call 020 7946 0961 please", [("phone", "020 7946 0961")]),
    ("ring 415 555 2698 tomorrow", [("phone", "415 555 2698")]),
    ("pay BE68 5390 0754 7034 now", [("account", "BE68 5390 0754 7034")]),
    ("pay BE68 5390 0754 7035 now", []),  # wrong check digits
    ("IBAN GB82 WEST 1234 5698 7654 32 ok", [("account", "GB82 WEST 1234 5698 7654 32")]),
    ("ssn 212-34-5678 ok", [("identity", "212-34-5678")]),
    ("ssn 000-34-5678 ok", []),
    ("password=qwerty123", [("secret", "qwerty123")]),
    ("password = hunter22 ok", [("secret", "hunter22")]),
    ("my password: letmein99", [("secret", "letmein99")]),
    ('x token = "0f8cab8ca1b325bc4f85aa6a79e73fc4cbfc2098"### y', [("secret", "0f8cab8ca1b325bc4f85aa6a79e73fc4cbfc2098")]),
    ("the token was lost", []), ("title: Introduction to tokens", []), ("x = 20 and rate=0.05", []),
    ("1914 to 1918; 300 400 5000 items", []), ("see https://a.example/x=1234abc", []),
    ("git commit 1234567890abcdef1234567890abcdef12345678", []),
    ("mail a@b.co, password = hunter22", [("email", "a@b.co"), ("secret", "hunter22")])])
def test_kinds_of_the_field(field, text, spans):
    assert [(pii.EVERY[k], text[s:e]) for k, s, e, _ in pii.all_spans([text], field)[0]] == spans


def test_neighbours_are_whole_words_at_any_distance(field):
    gap = " " * 5000
    assert pii._neighbour("password" + gap + "=" + gap + "x" * 3000, 5008, 5009) == ("password", "x" * 3000)
    text = "password" + gap + "=" + gap + "hunter22"
    assert [(k, text[s:e]) for k, s, e, _ in pii.all_spans([text], field)[0]] == [(pii.SECRET, "hunter22")]
    long = "password=" + "a1" * 20_000
    assert [(s, e) for _, s, e, _ in pii.all_spans([long], field)[0]] == [(9, len(long))]


def test_every_secret_of_the_corpus_is_found(spark, field):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    secret = re.compile(r'(?i)\b(?:password|token|secret|key)\s*=\s*"?([0-9a-z]{16,})')
    for text, spans in zip(texts, pii.all_spans(texts, field)):
        assert {m.span(1) for m in secret.finditer(text)} == {(s, e) for k, s, e, _ in spans if k == pii.SECRET}


def test_rows_nulls_and_whole_texts(spark, field):
    long = "word " * 200_000 + "tom@example.com"
    rows = [(1, None), (2, ""), (3, "é a@b.co, call +1 (499) 555-6503%%%"), (3, "é a@b.co, call +1 (499) 555-6503%%%"),
            (None, "1.2.3.4"), (4, long)]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, starts int, kinds string")
    out = pii.find(df, field).collect()
    got = sorted(((r["doc_id"], [(k, s, e) for k, s, e, b in zip(r["kinds"], r["starts"], r["ends"], r["base"]) if b])
                  for r in out), key=repr)
    assert got == sorted(((i, [(pii.KINDS[k], s, e) for k, s, e in brute(t or "")]) for i, t in rows), key=repr)
    assert pii.find(df.limit(0), field).count() == 0


def test_redact(field):
    redact = lambda t: pii.replaced(t, pii.all_spans([t], field)[0])
    assert redact("to a@b.co, call +1 (499) 555-6503%%%") == "to [EMAIL], call [PHONE]%%%"
    assert redact('api_key = "9f86d081884c7d659a2feaa0c55ad015"') == 'api_key = "[SECRET]"'
    assert redact("nothing") == "nothing"
