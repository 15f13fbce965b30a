"""A small source tree of our own in which every rule has a finding, and clean neighbours that have none."""

from __future__ import annotations

POSITIVE: dict[str, tuple[str, str]] = {
    "php.empty-catch": ("src/Quiet.php", "<?php\nfunction load() {\n    try {\n        go();\n    } catch (Oops $e) {\n    }\n}\n"),
    "php.exception-wrap-without-previous": ("src/Wrap.php", "<?php\nfunction wrap($x) {\n    try {\n        return go($x, true);\n    } catch (Oops $e) {\n        throw new StoreFailed($e->getMessage());\n    }\n}\n"),
    "php.error-obscuring-catch": ("src/Obscure.php", "<?php\nfunction obscure() {\n    try {\n        go();\n    } catch (Oops $e) {\n        throw new \\RuntimeException('failed');\n    }\n}\n"),
    "php.error-swallowing": ("src/Swallow.php", "<?php\nfunction swallow() {\n    try {\n        go();\n    } catch (Oops $e) {\n        error_log('failed');\n    }\n}\n"),
    "php.blanket-static-analysis-suppressions": ("src/Blanket.php", "<?php\n// @phpstan-ignore-next-line\ngo();\n"),
    "php.excessive-static-analysis-suppressions": ("src/Excess.php", "<?php\n/** @psalm-suppress A */\ngo();\n/** @psalm-suppress B */\ngo();\n/** @psalm-suppress C */\ngo();\n/** @psalm-suppress D */\ngo();\n"),
    "php.stacked-static-analysis-suppressions": ("src/Stack.php", "<?php\n// @psalm-suppress A\n// @psalm-suppress B\ngo();\n"),
    "php.commented-out-code": ("src/Disabled.php", "<?php\n// $total = $total + $price;\ngo();\n"),
    "php.catch-default-fallbacks": ("src/Fallback.php", "<?php\nfunction fallback() {\n    try {\n        return go();\n    } catch (Oops $e) {\n        return [];\n    }\n}\n"),
    "php.catch-returns-exception-message": ("src/Message.php", "<?php\nfunction message() {\n    try {\n        return go();\n    } catch (Oops $e) {\n        return $e->getMessage();\n    }\n}\n"),
    "php.generic-status-envelopes": ("src/Envelope.php", "<?php\nfunction envelope($rows) {\n    return ['ok' => true, 'rows' => $rows];\n}\n"),
    "php.generic-array-casts": ("src/Cast.php", "<?php\nuse function json_decode as parse;\nfunction cast($raw) {\n    $data = parse($raw, true);\n    return pick($data);\n}\n"),
    "php.debug-output": ("src/Debug.php", "<?php\nfunction debug($x) {\n    var_dump($x);\n    go();\n}\n"),
    "php.mock-heavy-tests-without-assertions": ("tests/MockedTest.php", "<?php\nclass MockedTest extends TestCase {\n    public function testRuns(): void {\n        $a = $this->createMock(A::class);\n        $b = $this->createMock(B::class);\n        run($a, $b);\n    }\n}\n"),
    "php.magic-numbers": ("src/Magic.php", "<?php\nfunction magic($x) {\n    if ($x > 37) {\n        go();\n    }\n}\n"),
    "php.misleading-phpdoc-types": ("src/Docs.php", "<?php\n/**\n * @param string $count\n */\nfunction docs(int $count): void {\n    go($count, true);\n}\n"),
    "php.placeholder-comments": ("src/Later.php", "<?php\n// TODO: name this\ngo();\n"),
    "php.pass-through-wrappers": ("src/Pass.php", "<?php\nfunction pass($a, $b) {\n    return other($a, $b);\n}\n"),
    "php.return-constant-stub": ("src/Stub.php", "<?php\nclass Stubborn {\n    public function label(): string {\n        return '';\n    }\n}\n"),
    "php.placeholder-method-bodies": ("src/Hollow.php", "<?php\nclass Hollow {\n    public function later(): void {\n    }\n}\n"),
    "php.type-escape-hotspots": ("src/Escape.php", "<?php\nfunction escape(mixed $a, mixed $b): mixed {\n    return join((string) $a, $b);\n}\n"),
    "markdown.low-signal": ("docs/task-summary.md", "# Summary\n\n- Updated changes\n- [x] Validation completed\n- [x] Testing completed\n\n## Notes\n\n- Follow-up later\n"),
}

_SETUP = "<?php\nclass {0} extends TestCase {{\n    public function test{0}(): void {{\n        $store = $this->createMock(Store::class);\n        $store->method('get')->willReturn({1});\n        $this->assertSame({1}, $store->get());\n    }}\n}}\n"
_CLONE = "<?php\nnamespace {0};\nfunction {1}($rows) {{\n    $kept = keep($rows);\n    sort($kept);\n    return wrap($kept, $rows, 'all of them');\n}}\n"

GROUPED: list[tuple[str, str]] = [
    *[(f"tests/set/S{i}Test.php", _SETUP.format(f"S{i}Test", "true")) for i in range(3)],
    ("lib/api/One.php", _CLONE.format("One", "gather")),
    ("modules/old/Two.php", _CLONE.format("Two", "collect")),
    ("lib/sig/A.php", "<?php\nfunction shared($a) {\n    one($a);\n}\n"),
    ("lib/sig/B.php", "<?php\nfunction shared($b) {\n    two($b);\n}\n"),
    *[(f"lib/many/f{i}.md", "Plain words about `one` thing.\n") for i in range(13)],
    *[(f"lib/tiny/T{i}.php", f"<?php\nfunction tiny{i}($a) {{\n    go($a, true);\n}}\n") for i in range(6)],
]

CLEAN: list[tuple[str, str]] = [
    ("app/Handled.php", "<?php\nfunction handled($x) {\n    try {\n        return go($x, true);\n    } catch (Oops $e) {\n        report($e);\n        throw $e;\n    }\n}\n"),
    ("app/Previous.php", "<?php\nfunction previous($x) {\n    try {\n        return go($x, true);\n    } catch (Oops $e) {\n        throw new \\RuntimeException('no', previous: $e);\n    }\n}\n"),
    ("app/Doc.php", "<?php\n/**\n * @param list<string> $names\n * @return int the number kept\n */\nfunction keepAll(array $names): int {\n    return total($names, true);\n}\n"),
    ("notes/guide.md", "# Installing\n\nRun `make all` first and then read [the manual](docs/manual.md) for the options that matter to you.\n\nThe server reads its settings once when it starts and never looks at them again.\n"),
    ("vendor/lib/Bad.php", "<?php\nvar_dump(1);\n"),
]

CORPUS: list[tuple[str, str]] = [*POSITIVE.values(), *GROUPED, *CLEAN]
