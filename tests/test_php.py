"""The PHP front end: lexer, parser and facts."""

import pytest

from gritsieve.functions.php_facts import NAMES, Facts, normalized_number
from gritsieve.functions.php_lexer import PhpSyntaxError, comments, tokens
from gritsieve.functions.php_parser import find, parse


def facts(body, path="src/a.php"):
    return Facts(path, "<?php\n" + body)


def test_comments_also_of_broken_source():
    assert comments("<h1>// no</h1><?php // one ?> # text <?php # two\n/* three\n*/ $a = '// no'; #[Attr]\n/** doc */ $x = \"unterminated") == [("// one ", 1), ("# two", 1), ("/* three\n*/", 2), ("/** doc */", 4)]


@pytest.mark.parametrize("source", [
    "$a = fn(int ...$x): ?int => $x[0] ?? throw new E(...);", "class A { use B, C { B::x insteadof C; } public private(set) ?int $p = 1 { get => 2; } const int X = 1; case Y = 2; }",
    "enum Suit: string implements I { case Hearts = 'H'; public static function f(): static { return self::Hearts; } }", "if ($a): echo 1; elseif ($b): echo 2; else: echo 3; endif;", "switch ($x) { case 1: case 2; break; default: }",
    "foreach ($a as $k => [$x, 'y' => $y]) { continue 2; } for (;;) break; while (1): endwhile; do { } while (0);", "$x = <<<EOT\n  a {$b->c['d']} ${e} $f[0]\n  EOT;\n$y = <<<'N'\nraw $no\nN;", "namespace A\\B; use function C\\{d, e as f}; use const X; function g() { yield from h(); yield $a => $b; static $n = 0; global $m; }",
    "$o?->p()->q::$r[1]['s'] = &$t; [$a, , $b] = list($c) = $d; $x ??= $y ?: $z <=> 1 ** 2 . 'a' instanceof B;", "#[A(1), B]\nabstract class C extends D implements E, F { abstract protected function f(#[G] self|(H&I)|null $x = new J, &...$r): never; }",
    "declare(strict_types=1); try { } catch (A|B) { } finally { } goto end; end: exit(1); ?> html <?= $x ?> more", "new class(1) extends B { }; match (true) { 1, 2 => 3, default => 4, }; print 1; clone $x; include 'a'; isset($a, $b); empty($c); @$d; `ls $e`;",
])
def test_parses(source):
    assert parse("<?php\n" + source)


@pytest.mark.parametrize("source", ["function {", "if (", "$a = ;", "class A { function }", "try { }", "'open", "foo(1 2);"])
def test_rejects(source):
    with pytest.raises(PhpSyntaxError):
        parse("<?php " + source)


def test_precedence_and_links():
    (s,) = parse("<?php return $a + $b * 2 . 'x' === $c && !$d;")
    assert (s.expr.op, s.expr.left.op, s.expr.left.left.op, s.expr.left.left.left.op) == ("&&", "===", ".", "+")
    assert all(c.parent is n for n in s.walk() for c in n.children())


def test_tokens_keep_byte_places():
    text = "<?php $é = 'ü';".encode().decode("latin-1")
    t = [x for x in tokens(text) if x.kind == "str"][0]
    assert (t.start, t.line) == (12, 1)


@pytest.mark.parametrize(("value", "want"), [("1", "1"), ("007", "7"), ("1.0", "1"), ("-5", "-5"), ("1e3", "1000"), ("0.1", "0.1"), ("0x1A", None), ("1_000", None), ("", None), ("1a", None), (".5", "0.5")])
def test_numbers(value, want):
    assert normalized_number(value) == want


def test_magic_numbers():
    f = facts("function f($x) { $a = ['3' => '42', 5]; return $x > 1 && -2 && 0x10 && 1_000 && $x + 2.50; }")
    assert [(v, n, k) for v, n, k, *_ in f.functions()[0][7]] == [("42", "42", "numeric-string"), ("5", "5", "numeric"), ("1", "1", "numeric"), ("-2", "-2", "numeric"), ("2.50", "2.5", "numeric")]


def test_functions():
    f = facts("namespace N; interface I { function no(); } abstract class A { function One($a, $b) { return two($a, $b); } } function c() { if (1) { function d() { return 0.0; } } } function e($a) { return f(...$a); }")
    assert [(r[0], r[1], r[5], r[6], r[8], r[9], r[10]) for r in f.functions()] == [
        ("One", "a::one(2)", ("two", ["$a", "$b"]), None, "abstract-class", "A", "N"), ("c", "c(0)", None, None, None, None, "N"), ("e", "e(1)", None, None, None, None, "N"),
    ]
    assert facts("function a() { return ''; } function b() { return []; } function c() { return NULL; } function d() { return true; }").functions()[0][6] == "empty-string"


def test_layout_does_not_change_bodies():
    a, b = (facts(s).functions()[0][3] for s in ("function f() { $a=1 ; /* x */ return $a ; }", "function f()\n{\n    $a = 1;\n    return $a;\n}"))
    assert a == b != ""


def test_catches():
    f = facts("""function f() { try { a(); } catch (E $e) { echo 1; \\Log(2); $x->no(); if (1) { return false; } throw new \\RuntimeException("x $e", 0, $e); }
    catch (F $e) { return (string) $e->x; } catch (G) { throw new H(previous: $y); } }""")
    one, two, three = f.catches()
    assert one[5:8] == (["echo", "log"], ["false"], []) and one[8] == [("RuntimeException", True, True, True)]
    assert two[7] == ["caught-string"] and three[8] == [("H", False, False, False)]


def test_normalizations_respect_scopes():
    f = facts("""function f() { try { a(); } catch (E $e) { $error = $e->getMessage(); $x = ['message' => (string) $e]; $g = function () { $reason = $e->getMessage(); };
    $h = function () use ($e) { $reason = $e->getMessage(); }; try { b(); } catch (F $e) { $detail = $e->getMessage(); } return $e->getMessage(); } }""")
    assert [n[0] for n in f.normalizations()] == ["assigned-caught-message", "property-caught-string", "assigned-caught-message", "assigned-caught-message", "returned-caught-message"]


def test_casts_and_envelopes():
    f = facts("use Symfony\\JsonResponse as J; $data = (array) $x; $payload = json_decode($s, associative: true); $rows = (array) $x; $obj = json_decode($s, false); return new J(['OK' => true, 'Data' => 1, 'errors' => []]);")
    assert [(c[0], c[1]) for c in f.array_casts()] == [("$data", "array-cast"), ("$payload", "json-decode-assoc")]
    assert [(e[0], e[1], e[2], e[3]) for e in f.envelopes()] == [("ok", "true", ["data", "errors"], "json-generic-status-envelope")]


def test_test_summary_and_mocks():
    f = facts("class T extends \\PHPUnit\\Framework\\TestCase { function testOne() { $m = $this->createMock(A::class); $m->method('x')->willReturn(1); $m = 2; $m->method('x')->willReturn(1); $this->assertSame(1, 2); self::assertTrue(1); $x->assertNo(); } #[Test] function two() { $q = $this->getMockBuilder(B::class)->getMock(); $q->expects($z); } }")
    assert f.looks_like_test() and f.test_calls(True) == (True, 2, 2, 2, 1)
    assert [m[0] for m in f.mock_setups(True)] == ["getMockBuilder|getMock", "method|willReturn"]


def test_phpdoc():
    f = facts("class A {\n/** @var ?string */\nprivate string $p;\n/**\n * @param int $a the count\n * @return list<int>\n */\nfunction f(int $a): array {}\n}")
    assert [(e[1], a[0], a[4], a[5], a[6], a[7]) for e in f.phpdoc() for a in e[4]] == [("A::$p", "@var $p", "string", "?string", "?string", None), ("A::f", "@param $a", "int", "int", "int $a the count", None), ("A::f", "@return", "array", "list<int>", "list<int>", "list<int>")]


def test_broken_source_keeps_comments():
    f = facts("// note\nfunction {")
    row = f.row()
    assert row[1] == [("// note", 2)] and row[2] == [] and row[4][3]
    assert find(f.statements, "Function") == []


SOURCE = "/** @param int $a */\nfunction f($a) { try { g(37); } catch (E $e) { return (string) $e; } }\nclass T { function testA() { $m = $this->createMock(A::class); } }"


def test_batches_are_parsed_in_bounded_pieces(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from gritsieve.operators import facts as stage
    from gritsieve.schema import FACTS, of

    texts = ["<?php\n" + SOURCE] * 600 + ["<?php /*" + "x" * (3 << 20) + "*/ echo 1;"] * 3 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"path": [f"tests/{i}.php" for i in range(len(texts))], "language_id": ["php"] * len(texts), "text": texts})
    parts = list(stage.pieces(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(0 < p.num_rows <= stage.PIECE_ROWS for p in parts) and all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= stage.PIECE_BYTES for p in parts)
    made = list(stage._extend(to_arrow_schema(of(FACTS)), ["path"])(iter([batch])))
    assert max(m.num_rows for m in made) <= stage.PIECE_ROWS and [p for m in made for p in m["path"].to_pylist()] == batch["path"].to_pylist()


def test_only_the_facts_asked_for_are_computed():
    f = Facts("tests/a.php", "<?php\n" + SOURCE)
    every = dict(zip(NAMES, f.row()[1:], strict=True))
    for name in NAMES:
        g = Facts("tests/a.php", "<?php\n" + SOURCE)
        for other in set(NAMES) - {name, "comments"}:
            setattr(g, other, None)  # a call would fail
        assert g.row([name]) == ("tests/a.php", every[name])


def test_a_released_source_goes_without_the_collector():
    import gc
    import weakref

    gc.disable()
    try:
        f = Facts("tests/a.php", "<?php\n" + SOURCE)
        f.row()
        f.release()
        gone = weakref.ref(f)
        node = f.statements[0].name  # outlives its tree
        del f
        assert gone() is None and node.parent is None
    finally:
        gc.enable()


def test_bodies_with_markup_are_printed():
    assert [r[3] for r in facts("function f() { ?> it's <b><?php echo 1; }").functions()] == ["it's <b> echo 1;"]
