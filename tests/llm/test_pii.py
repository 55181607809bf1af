import re

from pyspark.sql import functions as F

from ratingkit.llm import pii

from .helpers import CLASH, awkward_rows, frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(odd)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            s, digits = m.group(), re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def text_of(spans):
    order = list(PLAIN)
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1])))


ODD = [
    "a@b.c_d@e.f x@y z@.q bob@x.y.z. a@b@c.d", "1.2.3.4 256.1.1.1 000255.0.0.01 1.2.3 1.2.3.4.5.6.7.8 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 6011000990139424 12 34 5",
    "+1 (017) 555-7713 ++49 30 1234567 +1 2 +123456789012345678 +4", "é😀 bob@x.y 中文 +49 30 1234567é10.0.0.1",
    "1" * 5000, "a" * 20000 + "@b", "a@b" + ".c" * 20000, "+1" + " " * 3000 + "2345678", "7 " * 4000,
    "%%% a.b%c+d-e@mail-1.example.com%%% (10.0.0.1)", "\n4111111111111111\t5500000000000004", "@ + . - 1",
]


def test_base_spans_equal_brute_force(spark):
    rows = [(k, t, "s") for k, t in enumerate(ODD)] + [(100 + d, t, s) for d, t, s in awkward_rows()]
    rows += [(None, ODD[0], "s"), (5, ODD[2], "s"), (5, ODD[2], "s")]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    want = sorted((d or -1, text_of(base_spans(t))) for d, t, _ in rows)
    assert sorted((r["doc_id"] or -1, r["base"]) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r["base"].split(",") if s]
        assert [r[f"n_{k}"] for k in PLAIN] == [kinds.count(k) for k in PLAIN]
        assert set(s for s in r["base"].split(",") if s) <= set(r["spans"].split(","))


def planted():
    """Seeds in a few contexts; identifiers without the form of a seed in the same contexts."""
    rows = []
    for k in range(6):
        rows.append((k, f"note {k} please write mail to user{k}@firm{k}.example.com or wait", "a"))
        rows.append((20 + k, f"open ticket number {k * 37 + 5} today", "a"))
        rows.append((30 + k, f"dial it: +4930123456{k} soon", "a"))
    rows += [(80 + k, f"you may call me at +1 (20{k}) 555-010{k} tonight", "a") for k in range(14)]
    rows += [(40, "again write mail to jürgen@intern, or not", "b"), (41, "just call me at (201) 555-0199 ok", "b"),
             (42, "number of items: 5550199 in stock", "b"), (43, "dial it: 0301234567 soon", "b")]
    # (20x) numbers without plus stand in a second context, which they alone make trusted
    rows += [(50 + k, f"just call me at 0201 555 019{k} ok", "c") for k in range(4)]
    rows += [(60 + k, f"reach us under 0201 555 019{k} daily", "c") for k in range(4)]
    rows += [(70, "reach us under 0888 777 666 daily", "c")]
    return rows


def brute_force(rows, rounds=pii.ROUNDS, support=pii.SUPPORT, confidence=pii.CONFIDENCE):
    """Spans of all rows, by plain loops over the graph."""
    import math
    space = r"[^\x20\x09-\x0D]"
    found = []
    for rid, (_, text, _) in enumerate(rows):
        text = text or ""
        base = base_spans(text)
        own = [(k, a, b, a, b) for k, a, b in base]
        for m in re.finditer(pii.CANDIDATE, text):
            s, a = m.group(), m.start()
            a += len(s) - len(s.lstrip(pii._QUOTES))
            s = s.lstrip(pii._QUOTES).rstrip(pii._ENDS)
            if s and not any(a < y and x < a + len(s) for _, x, y in base):
                own.append((None, a, a + len(s), m.start(), m.end()))
        for group in (*PLAIN, None):
            if group:
                marks = [m.span() for m in re.finditer(PLAIN[group], text)]
            else:
                marks = [m.span() for m in re.finditer(pii.CANDIDATE, text)]
            for kind, a, b, x, y in own:
                if kind != group:
                    continue
                at = marks.index((x, y))
                gap_l = text[marks[at - 1][1] if at else 0:x][-pii.WINDOW:]
                gap_r = text[y:marks[at + 1][0] if at + 1 < len(marks) else len(text)][:pii.WINDOW]

                def words(t):
                    t = re.sub("[0-9]+", "0", t.lower())
                    return re.findall(space + "+", re.sub(r"[.,;!?]+(?=[\x20\x09-\x0D]|$)", "", t))
                lw, rw = words(gap_l), words(gap_r)
                if lw:
                    two = [lw[-2] if len(lw) > 1 else "^", lw[-1], "_"]
                    ctx = [" ".join(two), " ".join([lw[-1], "_", rw[0] if rw else "$"])]
                else:
                    ctx = []
                found.append((rid, kind, a, b, text[a:b].lower(), ctx))
    edges = {}
    for _, kind, _, _, s, ctx in found:
        for p in ctx:
            edges.setdefault(p, {}).setdefault(s, set()).add(kind)
    score, strong = {}, {}
    for turn in range(rounds):
        strong = {}
        for p, inst in edges.items():
            for k in PLAIN:
                total = sum(1_000_000 if k in seeds else score.get((s, k), 0) for s, seeds in inst.items())
                fits = sum(k in seeds if seeds - {None} else bool(re.search(pii.LOOSE[k], s)) for s, seeds in inst.items())
                conf = total and math.floor(4 * total / (3 * total + (4 * len(inst) - 3 * fits) * 1000000) * 1000000)
                if total >= support * 1e6 and conf >= confidence * 1e6:
                    strong[p, k] = conf
        score = {}
        for s in {s for inst in edges.values() for s, seeds in inst.items() if seeds == {None}}:
            for k in PLAIN:
                got = [strong[p, k] for p, inst in edges.items() if s in inst and (p, k) in strong]
                if got and re.search(pii.LOOSE[k], s):
                    left = math.exp(sum(math.log(1 - min(c / 1e6, 0.999)) for c in got))
                    score[s, k] = round((1 - left) * 1e6)
    out = {rid: base_spans(t) for rid, (_, t, _) in enumerate(rows)}
    for rid, kind, a, b, s, ctx in found:
        if kind is None:
            claims = [(strong[p, k], -n, k) for p in ctx for n, k in enumerate(PLAIN)
                      if (p, k) in strong and re.search(pii.LOOSE[k], s)]
            if claims:
                out[rid].append((max(claims)[2], a, b))
    return out


def test_patterns_discover_unseen_identifiers(spark):
    rows = planted()
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    text = {d: t for d, t, _ in rows}

    def found(d):
        return [(s.split(":")[0], text[d][int(s.split(":")[1]):int(s.split(":")[2])]) for s in got[d].split(",") if s]
    assert found(40) == [("email", "jürgen@intern")]
    assert found(41) == [("phone", "(201) 555-0199")]
    assert found(43) == [("phone", "0301234567")]
    assert found(42) == [] and all(found(20 + k) == [] for k in range(6))
    # a context without any seed is trusted once its instances are, and finds more
    assert found(70) == [("phone", "0888 777 666")]
    one = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame(spark, rows), rounds=1).collect()}
    assert one[70] == "" and one[41]


def test_equal_to_plain_loops(spark):
    rows = planted() + [(200 + d, t, s) for d, t, s in awkward_rows()] + [(300 + k, t, "s") for k, t in enumerate(ODD)]
    want = brute_force(rows)
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert got == {d: text_of(want[k]) for k, (d, _, _) in enumerate(rows)}


def test_empty_table_and_plan_without_python(spark):
    docs = frame(spark, [(1, "a@b.c", "s")])
    assert set(CLASH) <= set(docs.columns)
    assert pii.find_personal_data(docs.where(F.lit(False))).collect() == []
    plan = pii.find_personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
