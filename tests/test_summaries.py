"""Summaries against exact strings derived by hand."""

from collections import Counter

from pyspark.sql import functions as F

from logdistill.functions import summaries as S
from logdistill.functions.signatures import extract_signatures

HDR = "Traceback (most recent call last):"


def frame(path, line, fn, src="x()"):
    return f'  File "{path}", line {line}, in {fn}\n    {src}\n'


def run(spark, texts, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t")).alias("x")).collect()]


def test_flood_exact(spark):
    assert run(spark, ["\n".join(["a"] * 200)], S.summarize) == [
        "[Repetitive output: 200 total line(s), 1 unique]\n  ×   200  a"
    ]


def test_flood_order_ties_width_and_rest(spark):
    others = [f"l{i}" for i in (5, 3, 1, 2, 4, 6, 8, 7, 9)]
    text = "\n".join(["  " + "d" * 130, ""] * 20 + others + ["l9"])
    rows = ["[Repetitive output: 30 total line(s), 10 unique]", "  ×    20  " + "d" * 120 + "…",
            "  ×     2  l9"] + [f"  ×     1  {x}" for x in others[:6]] + ["  … and 2 more unique line(s)"]
    assert run(spark, [text], S.summarize) == ["\n".join(rows)]


def test_flood_counts_few_and_many_kinds_alike(spark):
    """Kinds are counted one by one up to ``FEW_KINDS``, beyond from sorted lines; blanks of any kind go."""
    texts = []
    for kinds in (1, 9, S.FEW_KINDS, S.FEW_KINDS + 1, 90):
        rest = [f"k{i * 7 % kinds}" for i in range(1, kinds)]
        lines = ["hot"] * (3 * kinds + 10) + rest + rest[::-2]
        for pad in ("", "  ", "\t", "\u3000"):
            texts.append("\n".join(pad + x + pad for x in lines))

    def table(t):
        n = Counter(x.strip() for x in t.splitlines())  # in order of first sight, as ties are shown
        rows = [f"  × {k:5d}  {x}" for x, k in sorted(n.items(), key=lambda x: -x[1])[:8]]
        more = [f"  … and {len(n) - 8} more unique line(s)"] if len(n) > 8 else []
        title = f"[Repetitive output: {n.total()} total line(s), {len(n)} unique]"
        return "\n".join([title, *rows, *more])

    assert run(spark, texts, S.summarize) == [table(t) for t in texts]


def test_flood_gates(spark):
    texts = ["\n".join(["a"] * 9), "\n".join(f"u{i}" for i in range(50)), "", "\n \n"]
    assert run(spark, texts, S.summarize) == [None] * 4


def test_traceback_exact(spark):
    text = HDR + "\n" + frame("/app/a.py", 1, "f") + frame("/usr/lib/python3/x.py", 2, "g") + "KeyError: 'k'\n"
    assert run(spark, [text], S.summarize) == ["── Traceback ──\n  at /app/a.py:1 in f\n  ↳ KeyError: 'k'"]


def test_chained_numbers_blocks_and_drops_text_between(spark):
    one = HDR + "\n" + frame("/app/a.py", 1, "f") + "OSError: no\n"
    text = one + "\nDuring handling of the above exception, another exception occurred:\n\n" + one
    block = "── Traceback {}/2 ──\n  at /app/a.py:1 in f\n  ↳ OSError: no"
    assert run(spark, [text], S.summarize) == [block.format(1) + "\n\n" + block.format(2)]


def test_last_three_user_frames_or_last_three(spark):
    user = "".join(frame("/app/a.py", i, "f") for i in range(1, 6))
    lib = "".join(frame("/usr/lib/python3/x.py", i, "g") for i in range(1, 6))
    texts = [HDR + "\n" + user + lib + "E: x", HDR + "\n" + lib + "E: x", HDR + "\nE: x"]
    assert run(spark, texts, S.summarize) == [
        "── Traceback ──\n" + "\n".join(f"  at /app/a.py:{i} in f" for i in (3, 4, 5)) + "\n  ↳ E: x",
        "── Traceback ──\n" + "\n".join(f"  at /usr/lib/python3/x.py:{i} in g" for i in (3, 4, 5)) + "\n  ↳ E: x",
        "── Traceback ──\n\n  ↳ E: x",
    ]


def test_context_is_condensed_or_kept(spark):
    tb = HDR + "\n" + frame("/app/a.py", 1, "f") + "KeyError: 'k'\n"
    body = "── Traceback ──\n  at /app/a.py:1 in f\n  ↳ KeyError: 'k'"
    table = "[Repetitive output: 20 total line(s), 1 unique]\n  ×    20  W"
    texts = ["W\n" * 20 + tb, tb + "2 failed\n", " start \n" + tb + "W\n" * 20, tb + "\n \n"]
    assert run(spark, texts, S.summarize) == [
        table + "\n\n" + body, body + "\n\n2 failed", "start\n\n" + body + "\n\n" + table, body,
    ]


def test_bare_exceptions_close_a_block(spark):
    tb = HDR + "\n" + frame("/app/a.py", 1, "f")
    texts = [tb + "KeyboardInterrupt\n", tb + "StopIteration\nexit 1\n"]
    body = "── Traceback ──\n  at /app/a.py:1 in f\n  ↳ "
    assert run(spark, texts, S.summarize) == [body + "KeyboardInterrupt", body + "StopIteration\n\nexit 1"]


def test_open_blocks(spark):
    tb = HDR + "\n" + frame("/app/a.py", 1, "f")
    two = tb + "OSError: no\nlog\n" + tb
    texts = [tb, "    " + tb.replace("\n", "\n    ") + "    E: indented\n", two]
    block = "── Traceback{} ──\n  at /app/a.py:1 in f\n  ↳ "
    assert run(spark, texts, S.summarize) == [
        block.format(""), block.format(""),
        block.format(" 1/2") + "OSError: no\n\n" + block.format(" 2/2")
        + "\n\nlog\n" + tb.strip(),
    ]


def test_coloured_traceback(spark):
    tb = "\x1b[31m" + HDR + "\x1b[0m\n" + frame("/app/a.py", 1, "f") + "\x1b[1mKeyError: 'k'\x1b[0m\n"
    assert run(spark, [tb], S.summarize) == ["── Traceback ──\n  at /app/a.py:1 in f\n  ↳ KeyError: 'k'"]


def test_rust_exact_and_cap(spark):
    wall = lambda n, r: "\n".join(
        f"error[E{3000 + i}]: bad {i} at {j}\n  --> src/m.rs:{j}\nwarning[W1]: w" for i in range(n) for j in range(r)
    )
    few, many = run(spark, [wall(5, 3), wall(31, 2)], S.summarize)
    assert few == "[Rust build: 15 error(s), 15 warning(s) → 5 unique error(s)]\n" + "\n".join(
        f"  error[E{3000 + i}]: bad {i} at 0" for i in range(5)
    )
    assert len(many.splitlines()) == 32 and many.endswith("\n  … and 1 more unique error(s)")


def test_gcc_exact_and_cap(spark):
    diag = [f"src/m_{i}.cpp:{i}:8: error: no {i}" for i in range(20)]
    got = run(spark, ["\n".join(x + "\n   1 | code" for x in diag)], S.summarize)[0].splitlines()
    assert got[0] == "[C/C++ build: 20 error(s), 0 warning(s) → 20 unique diagnostic(s)]"
    assert got[1:16] == ["  " + x for x in diag[:15]] and got[16:] == ["  … and 5 more"]


def test_signatures_survive(spark):
    tb = HDR + "\n" + frame("/app/a.py", 1, "f") * 20 + "ValueError: bad value\n"
    assert run(spark, [tb], lambda c: F.array_except(extract_signatures(c), extract_signatures(S.summarize(c)))) == [[]]
