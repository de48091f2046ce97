"""Mapping of typed values to the canonical list."""

from __future__ import annotations

import pytest

from metaloom.llm.canonical import Matcher, acronyms, allowed, deletions, map_to_canonical, slips, unmatched, words

NAMES = [
    (1, "supplier_invoice_lead_time", ["days until done of supplier invoice", None, " "]), (2, "Refund Rate", ["rref", "refund percentage"]), (3, "partner payout unit cost", ["PPUC"]),
    (4, "basket volume", []), (5, "supplier invoice gross margin", ["zabufafi index"]), (6, "refund lost revenue", None), (7, "basket size", ["number of basket"]),
]


LIST = [(i, tuple(words(x))) for i, n, s in NAMES for x in [n, *(s or [])] if x and words(x)]


def matcher(frequent=None, own=()):
    decorations = "final kpi jump yesterday show region owns compare shops model keep".split()
    return Matcher(LIST, frequent or {}, frozenset(decorations), frozenset(own))


@pytest.mark.parametrize(("typed", "want"), [
    ("Supplier Invoice LEAD time", 1), ("supplierInvoiceLeadTime", 1), ("supplierinvoiceleadtime", 1), ("suplier-invioce lead time", 1), ("suppl inv lead time", 1), ("lead time of supplier invoice", 1), ("dayss until done of suplier invoice", 1), ("days untli done of supplier invoice", 1), ("daysutnildoneofsupplierinvoice", 1), ("suplpier inovice laed time", 1), ("no of basket", 7), ("bassekt volume", 4),
    ("ｒｅｆｕｎｄ ｒａｔｅ", 2), ("ré​fund rate.", 2), ("R.R.E.F", 2), ("refund pct", 2), ("our refund rate (final)", 2), ("ppuc kpi", 3), ("unit cost: partner payout", 3), ("prtnerpayoutunitcost", 3), ("zabufai index", 5),
    ("partner payout fixed cost", 0), ("refund gained revenue", 0), ("basket volume discount", 0), ("basketvolumediscount", 0), ("refund", 0), ("xx", 0), ("???", 0), ("rrex", 0), ("supplier invoice net margin", 0), ("tide height", 0),
])
def test_values(typed, want):
    assert matcher({"discount": 9, "gained": 9, "fixed": 9}).resolve(typed, False)[0] == want


@pytest.mark.parametrize(("typed", "want"), [
    ("why did partner payout unit cost jump yesterday", 3), ("show me refnd rate by region", 2), ("who owns basket volume discount", 0), ("compare PPUC between both shops", 3), ("which model has supplierInvoiceGrossMargn", 5), ("where do we keep tide height", 0),
])
def test_queries(typed, want):
    assert matcher({"discount": 9}).resolve(typed, True)[0] == want


def test_a_word_of_its_own():
    assert matcher().resolve("supplier invoice dead time", False)[0] == 1  # one slip
    assert matcher(own=["dead"]).resolve("supplier invoice dead time", False)[0] == 0


def mapped(spark, values, names=NAMES):
    df = spark.createDataFrame(list(enumerate(values)), "entry_id long, typed string")
    inv = spark.createDataFrame(names, "indicator_id long, indicator_name string, synonyms array<string>")
    return {r.entry_id: r.indicator_id for r in map_to_canonical({"t": (df, "typed", False)}, inv).collect()}


def test_decorations_are_learned(spark):
    """Words that no list holds: spread over many names they decorate, kept to one word they make another quantity."""
    subjects, measures = ["alpha", "bravo", "cargo", "delta", "ember"], ["margin", "volume", "backlog"]
    names = [(i, f"{a} {m}", []) for i, (a, m) in enumerate(((a, m) for a in subjects for m in measures), 1)]
    plain = [n for _, n, _ in names]
    values = [f"zorptember {n}" for n in plain[:9]] + [f"{n} quux" for n in plain[3:]] + [f"{a} volume rebate" for a in subjects] + [f"{n} once" for n in plain[:1]]
    got = mapped(spark, values, names)
    want = [n for n, _, _ in names[:9]] + [n for n, _, _ in names[3:]] + [0] * 5 + [0]
    assert [got[i] for i in range(len(values))] == want


def test_own_words_do_not_depend_on_traffic(spark):
    """"dead time" repeated over contexts is another quantity however popular "lead time" is; a lone slip is not."""
    subjects = [f"{a}{b}" for a in ("night", "sales", "cargo", "fleet", "store") for b in ("desk", "yard", "hall", "pool", "line", "post")]
    names = [(i, f"{s} lead time", []) for i, s in enumerate(subjects, 1)]
    popular = [f"{s} lead time" + d for s in subjects for d in ("", " 1", " 2", " 3", " 4", " 5", " 6", " 7", " 8", " 9")] * 3
    values = [f"{s} dead time" for s in subjects[:8]] + ["nightdesk leaf time"] + popular
    got = mapped(spark, values, names)
    assert [got[i] for i in range(8)] == [0] * 8 and got[8] == 1 and all(got[i] for i in range(9, len(values)))


def test_short_names_allow_slips_and_abbreviations_do_not():
    names = [(1, ("margin",)), (2, ("refund", "rate")), (2, ("rref",)), (3, ("revenue",)), (4, ("cash", "register", "rate")), (4, ("crras",)), (5, ("taxes",))]
    assert acronyms(names) == {"rref", "crras"}
    m = Matcher(names)
    for typed, want in {"margins": 1, "margn": 1, "revenu": 3, "rref": 2, "rrex": 0, "crrax": 0, "taxesrefund": 0, "taxs": 5, "refundrate": 2}.items():
        assert m.resolve(typed, False)[0] == want, typed


@pytest.mark.parametrize("blocks", [1, 2, 4, 8])
def test_blocks_of_names_change_nothing(spark, blocks):
    typed = ["refnd rate", "prtnerpayoutunitcost", "supplier invoice lead time kpi", "basket volum", "ppuc", "nothing", "zabufai index", "no of basket"]
    df = spark.createDataFrame(list(enumerate(typed)), "entry_id long, typed string")
    inv = spark.createDataFrame(NAMES, "indicator_id long, indicator_name string, synonyms array<string>")
    got = {r.entry_id: r.indicator_id for r in map_to_canonical({"t": (df, "typed", True)}, inv, -(-17 // blocks)).collect()}
    assert [got[i] for i in range(len(typed))] == [2, 3, 0, 4, 3, 0, 5, 7]


def test_slips_against_brute_force():
    ws = ["abcdef", "abcdfe", "bacdef", "abdef", "abccdef", "xbcdef", "xbcdxf", "fedcba", ""]
    for a in ws:
        for b in ws:
            assert slips(a, b, 9) == slips(b, a, 9)
            if slips(a, b, 1) <= 1:
                assert deletions(a, 1) & deletions(b, 1)
    assert slips("abcdef", "abcdfe", 2) == 1 and slips("abcdef", "xbcdxf", 2) == 2 and slips("abcdef", "fedcba", 2) == 3 and allowed("rate") == 1


def test_tables(spark):
    schema = "entry_id long, typed string, indicator_id long, around string"
    rows = [(1, "refund rate", 9, "x"), (1, "refund rate", 9, "x"), (2, None, 9, "x"), (3, "  ", 9, "x"), (4, "Refund  Rte", 9, "x"), (5, "nothing such", 9, "x"), (6, "w " * 30_000 + "refund rate", 9, "x")]
    inv = spark.createDataFrame(NAMES, "indicator_id long, indicator_name string, synonyms array<string>")
    df = spark.createDataFrame(rows, schema)
    for block in (100_000, 3):  # the second searches the list in blocks
        got = map_to_canonical({"t": (df, "typed", True)}, inv, block)
        assert sorted((r.entry_id, r.indicator_id) for r in got.collect()) == [(1, 2), (4, 2), (5, 0), (6, 0)]
    assert [(r.typed, r.entries) for r in unmatched(got).where("length(typed) < 99").collect()] == [("nothing such", 1)]
    assert {r.indicator_id for r in map_to_canonical({"t": (df, "typed", True)}, inv.limit(0)).collect()} == {0}
    assert map_to_canonical({"t": (df.limit(0), "typed", True)}, inv).count() == 0
