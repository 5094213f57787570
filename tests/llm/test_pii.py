import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logscope.llm import pii
from logscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def brute(text):
    """The four patterns as they are stated."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="a0@.-_ +", max_size=40), st.text(alphabet="0123456789. -+()", max_size=60),
                 st.from_regex(r"(4[ -]?){15,18}[0-9]|\+1[ (]555[).]1234567|1.2.3.4.5|a@b.c_d@e.f", fullmatch=True)))
def test_base_equals_the_patterns(text):
    assert sorted(pii.base_spans(text)) == brute(text)


@pytest.mark.parametrize("text", ["a" * 200000, "1" * 200000, "1." * 100000, "@" * 100000, "+1" + "(" * 100000, "a@b" * 50000])
def test_base_is_linear_on_odd_texts(text):
    assert [k for k, _, _ in pii.base_spans(text)].count(0) == 0


def fitted(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_query_equals_brute_force_and_leaves_clean_texts_alone(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(pii.written(base).split(",")) - {""} <= set(every)
        if not base:
            assert r.spans == ""


def test_labels_reach_distant_mentions(spark):
    model = fitted(spark)
    text = "Call +1 (535) 555-5412 now. " + "and then some words " * 300 + "as said, 555-5412, is the number of card 99."
    base, every = pii.spans(text, model)
    added = [text[a:b] for k, a, b in every if (k, a, b) not in base and k == 3]
    assert added == ["555-5412"]
    alone = text.replace("+1 (535) 555-5412", "someone")
    assert pii.spans(alone, model) == ([], [])


def test_messages_equal_brute_force_on_a_tree(spark):
    import itertools

    import numpy as np
    model = fitted(spark)
    text = "mail 12345 +1 (535) 555-5412 4.0 x 12345"
    g = pii.graph(text, pii.base_spans(text))
    p = model.marginals(g)
    n, total = len(g.words), np.zeros((len(g.words), pii.N_LABELS))
    for y in itertools.product(range(pii.N_LABELS), repeat=n):
        if any(l >= 0 and l != v for l, v in zip(g.label, y)):
            continue
        e = sum(model.node(s)[v] for s, v, l in zip(g.shapes, y, g.label) if l < 0)
        e += sum(model.chain[y[a], y[b]] for a, b in g.chain) + sum(model.skip[y[a], y[b]] for a, b in g.skip)
        for i, v in enumerate(y):
            total[i, v] += np.exp(e)
    assert np.allclose(p, total / total.sum(axis=1, keepdims=True), atol=5e-3)


def test_odd_rows_and_masking(spark):
    model = fitted(spark)
    rows = [(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "a.b@c.de and 1.2.3.4, ok", "z"), (3, "w " * 100000 + "a@b.cd", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.report(df, model).collect()
    assert [(r.doc_id, r.n_email, r.n_ip) for r in got] == [(None, 0, 0), (1, 0, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0)]
    out = [r[0] for r in df.select(pii.masked(df.text, model)).collect()]
    assert out[:4] == [None, "", "", "[email] and [ip], ok"] and out[4].endswith("w [email]")
    empty = df.limit(0)
    assert pii.report(empty, pii.fit(empty)).count() == 0


def test_labels_depend_on_the_model_and_not_on_another_base_match(spark):
    import numpy as np
    flat = np.zeros((pii.N_LABELS, pii.N_LABELS))
    sure = pii.Model({"digits=7": 9 * np.eye(pii.N_LABELS)[4]}, flat, flat)
    text = "as said, 555-5412, is it"
    assert pii.spans(text, sure) == ([], [(3, 9, 17)])
    assert pii.mask_text(text, sure) == "as said, [phone], is it"
    mail = " or a.b@c.de"
    assert pii.spans(text + mail, sure)[1][1:] == pii.spans(text, sure)[1]
    model = fitted(spark)
    assert [x for x in pii.spans(text + mail, model)[1] if x[0] != 0] == pii.spans(text, model)[1]


def test_labels_reach_the_last_of_many_mentions():
    import numpy as np
    near = 4 * np.eye(pii.N_LABELS)
    sure = pii.Model({}, 0 * near, near)
    text = "+1 555 555-5412 " + "and some words then 555-5412, " * 200
    p = sure.marginals(g := pii.graph(text, pii.base_spans(text)))[3:, 4]
    own = np.exp(near) / np.exp(near).sum(axis=1, keepdims=True)
    assert len(p) == 200 == len(g.skip) and np.allclose(p, [np.linalg.matrix_power(own, k + 1)[4, 4] for k in range(200)], atol=1e-3)


def test_shape_counts_the_whole_word():
    tail = pii.shape("/" * 70 + "4111111111111111abcd").split("|")
    assert {"digits=16", "luhn=True", "letters=3"} <= set(tail)


def test_other_groupings_of_a_number_are_linked():
    text = "+1 (535) 555-5412 then 535-555-5412 or 5355555412, also 535 555 5412 and 1 22 333"
    g = pii.graph(text, pii.base_spans(text))
    said = [text[a:b] for a, b in g.words]
    assert {("555-5412", "535-555-5412"), ("535-555-5412", "5355555412,"), ("5355555412,", "5412")} <= {(said[a], said[b]) for a, b in g.skip}
    assert all(a < b for a, b in g.skip) and len({*map(tuple, g.skip.tolist())}) == len(g.skip)


def planted(text, form, rnd):
    """``form`` as words of its own somewhere in ``text``, and where."""
    words = text.split(" ")
    i = rnd.randrange(len(words) + 1)
    before = " ".join(words[:i]) + " "
    return before + form + " " + " ".join(words[i:]), len(before), len(before) + len(form)


def test_recall_of_planted_forms_and_false_alarms(spark):
    """Numbers that no training text holds, in forms that no base pattern takes: recall
    of each form, alone in its text and said twice; forms that training did not plant;
    and numbers that are nobody's, some of kinds that training has no decoy of."""
    import random
    model, rnd = fitted(spark), random.Random(11)
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    clean = [t for t in docs if t and not pii.words(t)][:120]
    assert len(clean) == 120
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        while not luhn(d := "4" + digits(15)):
            pass
        return d

    def said():
        d, c, mail = digits(10), card(), f"jo{digits(2)}@mail{digits(1)}.example.com"
        ip = ".".join(str(rnd.randrange(1, 255)) for _ in range(4))
        made = [(k, f) for k, base in ((0, mail), (1, ip), (2, c), (3, "+1" + d)) for f in pii.other_forms(k, base)]
        return made + [(3, f"{d[:3]}/{d[3:6]}-{d[6:]}"), (2, "_".join(c[i:i + 4] for i in range(0, 16, 4)))]

    def nobody():
        return [f"20{digits(2)}-0{rnd.randrange(1, 10)}-1{digits(1)}", f"1{digits(1)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
                digits(6), digits(10), "@bob", f"${digits(2)},{digits(3)}.{digits(2)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
                "1b4e28ba-2fa1-11d2-883f-b9a761bde3fb", "covid-19", "1024x768", f"{digits(3)}-{digits(4)}"]

    hits, again, alarms = None, None, 0
    for text in clean:
        forms = said()
        hits, again = hits or [0] * len(forms), again or [0] * len(forms)
        for i, (kind, form) in enumerate(forms):
            one, a, b = planted(text, form, rnd)
            hits[i] += any(k == kind and s < b and e > a for k, s, e in pii.spans(one, model)[1])
            two = one + " or " + form
            found = [(s, e) for k, s, e in pii.spans(two, model)[1] if k == kind]
            again[i] += any(s < b and e > a for s, e in found) and any(e > len(one) for s, e in found)
        alarms += sum(pii.spans(planted(text, x, rnd)[0], model) != ([], []) for x in nobody())
    assert min(hits) >= 0.9 * len(clean) and min(again) >= 0.9 * len(clean), (hits, again)
    assert alarms <= 0.01 * 12 * len(clean)


def test_what_training_knows_of_a_text():
    text = "Call +1 (535) 555-5412, a.b@c.de, 1.2.3.4, 4929348385146306 or 4929348385146307 and 99"
    base = pii.base_spans(text)
    other, known = pii._replanted(text, base)
    said = {k: text[a:b] for k, a, b in base}
    first = {k: other[a:b] for k, a, b in reversed(known)}
    assert all(first[k] in [*pii.other_forms(k, said[k]), pii.short_form(k, said[k])] for k in (0, 2, 3)) and first[1].count("-") >= 3
    assert pii.base_spans(other.split(" and 99")[0]) == []
    g = pii.graph(text, base + pii._failed(text))
    label = {text[a:b]: int(v) for (a, b), v in zip(g.words, g.label)}
    assert label["4929348385146307"] == pii.OTHER and label["99"] == pii.UNLABELLED and label["4929348385146306"] == 3
    clean = "no match, 99 words"
    assert pii._replanted(clean, []) == (clean, [])


def test_messages_that_do_not_rest_are_reported():
    import numpy as np
    rnd = np.random.default_rng(1)
    text = " ".join(f"{rnd.integers(10, 30)}" for _ in range(60))
    g = pii.graph(text, [])
    hard = pii.Model({f"digits={d}": 0.1 * np.arange(pii.N_LABELS) for d in range(9)}, -6 * np.eye(pii.N_LABELS), -6 * np.eye(pii.N_LABELS))
    p, rest = hard.settled_marginals(g)
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1) and isinstance(rest, bool)
    soft = pii.Model({}, 0.1 * np.eye(pii.N_LABELS), 0.1 * np.eye(pii.N_LABELS))
    assert soft.settled_marginals(g)[1]
