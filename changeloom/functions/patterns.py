"""Patterns: the two glob dialects, ordered first matches and cascades, and predicates on paths, subjects and text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeloom.functions.scalars import basename, dirname

# Commit subjects, lockfiles, and files that change with everything.
FIX = r"(?i)\b(fix(es|ed|ing)?|bug(fix)?|hotfix|regression|incident|outage|crash(es|ed)?|panic(s|ed)?|broken|leak)\b"
NOT_FIX = r"(?i)\b(typos?|lint(er|ing)?|flaky|spelling|readme|docs?|comments?|format(ting)?)\b"
REVERT = r"^(Revert|revert)\b"
LOCKFILES = ["go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock"]
MANIFESTS = ["go.mod", "package.json", "Makefile", "Dockerfile", "CHANGELOG.md", "README.md", "Chart.yaml", "values.yaml"]


def _pieces(pattern: str, braces: bool) -> str:
    """A glob as a regular expression: tokens are read by one expression and replaced one by one."""
    plain = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    token = re.compile(r"\*\*/|\*\*|\*|\?" + (r"|\{[^}]*\}" if braces else ""))
    out, at = [], 0
    for m in token.finditer(pattern):
        out.append(re.escape(pattern[at : m.start()]))
        out.append(plain.get(m[0]) or "(?:" + "|".join(map(re.escape, m[0][1:-1].split(","))) + ")")
        at = m.end()
    return "".join(out) + re.escape(pattern[at:])


def map_glob(pattern: str) -> str:
    """The anchored expression of a glob of the map's rules: ** crosses directories, {a,b} are choices."""
    return f"^{_pieces(pattern, True)}$"


def policy_glob(pattern: str) -> Callable[[Column], Column]:
    """The predicate of a policy's pattern: without a slash it is for the last part of the path, with one at its end
    for a directory anywhere, else for the whole path."""
    pattern = pattern.removeprefix("/")
    if pattern.endswith("/"):
        folder = re.escape(pattern.rstrip("/"))
        return lambda path: path.rlike(f"(^|/){folder}/") | (path == pattern.rstrip("/"))
    expression = f"^{_pieces(pattern, False)}$"
    return (lambda path: path.rlike(expression)) if "/" in pattern else (lambda path: basename(path).rlike(expression))


def first_match(choices: list[tuple[str, Column]]) -> Column:
    """The name of the first predicate that holds, or null."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in choices])


def cascade(rules: list[tuple[Column, Column]]) -> Column:
    """The value of the first rule whose condition holds, or null; later conditions aren't looked at."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(F.lit(None))


def commit_kind(subject: Column, fix: str = FIX, not_fix: str = NOT_FIX, revert: str = REVERT) -> Column:
    """'revert', 'fix' or ''."""
    return F.when(subject.rlike(revert), "revert").when(subject.rlike(fix) & ~subject.rlike(not_fix), "fix").otherwise("")


def skipped(path: Column) -> Column:
    """Lockfiles and vendored code, which say nothing of co-change or authorship."""
    return basename(path).isin(LOCKFILES) | path.startswith("vendor/") | path.contains("/vendor/") | path.contains("node_modules/")


def no_partner(path: Column) -> Column:
    """Files that change with everything."""
    return basename(path).isin(MANIFESTS) | path.startswith(".github/") | path.endswith(".md")


def is_docs(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|txt|rst)$")


def generated_header(text: Column) -> Column:
    """Whether one line among the first 2048 characters says both that the code is generated and not to edit it."""
    lines = F.split(F.substring(text, 1, 2048), "\n")
    return F.exists(lines, lambda x: x.contains("Code generated") & x.contains("DO NOT EDIT"))


#: Changed lines that are imports or a package clause.
IMPORT_LINE = r'^[+-]\s*(import\s*\(?|\)|(\w+\s+)?"[^"]*"|import\s+(\w+\s+)?"[^"]*")?\s*(//.*)?$'
PACKAGE_LINE = r"^[+-]\s*(package\s+\w+)?\s*(//.*)?$"
RUNS_CODE = r'^[+-]\s*(import\s+)?[_.]\s+"'


def only_lines(changed: Column, pattern: str, but: str | None = None) -> Column:
    """Whether there are changed lines, all match, and none matches ``but``."""
    out = (F.size(changed) > 0) & F.forall(changed, lambda x: x.rlike(pattern))
    return out if but is None else out & ~F.exists(changed, lambda x: x.rlike(but))


#: What is a test whatever its language, and folders of tests in most languages.
TEST_ANYWHERE = r"_test\.go$|\.(test|spec)\.[^/]*$|__tests__/|(^|/)testdata/"
TEST_FOLDER = r"(^|/)(test|tests|spec|specs|__tests__|testing|Tests|androidTest|integration_test)/"

#: Extensions as they are, and the tests among them.
TESTS_AS_NAMED = {
    r"\.java$": r"src/test/|(Test|Tests|IT)\.java$",
    r"\.py$": r"(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$|(^|/)tests/",
    r"\.cs$": r"(Tests|Test)\.cs$|\.Tests/|(^|/)tests?/",
    r"\.rs$": r"(^|/)tests\.rs$|_tests?\.rs$|(^|/)(tests|benches)/",
}

#: Extensions in either case, whose tests are in TEST_FOLDER or named like this.
TESTS_BY_NAME = {
    r"\.(sh|bash)$": r"(_test\.sh|_test\.bash|\.test\.sh)$|(^|/)test_[^/]*$",
    r"\.(ps1|psm1)$": r"(?i)\.tests?\.ps1$",
    r"\.(c|cc|cpp|cxx|c\+\+|h|hh|hpp|hxx|h\+\+|ipp|tpp)$": r"(_test|_unittest|_tests|Test|Tests)\.[^./]*$|(^|/)test_[^/]*$",
    r"\.php$": r"Test\.php$",
    r"\.(scala|sc)$": r"src/test/|(Spec|Test|Suite|Tests)\.scala$",
    r"\.kt$": r"src/test/|(Test|Tests|Spec)\.kt$",
    r"\.(rb|rake)$": r"(_spec|_test)\.rb$|(^|/)test_[^/]*$",
    r"\.swift$": r"(Tests|Test)\.swift$",
    r"\.dart$": r"_test\.dart$",
}


def is_test(path: Column) -> Column:
    """Whether a file is a test, by its place and name in its language; Go's are only the files that its tools take for tests."""
    out = path.rlike(TEST_ANYWHERE)
    for ext, tests in TESTS_AS_NAMED.items():
        out = out | (path.rlike(ext) & path.rlike(tests))
    for ext, tests in TESTS_BY_NAME.items():
        out = out | (F.lower(path).rlike(ext) & (path.rlike(TEST_FOLDER) | path.rlike(tests)))
    return out


def follows_source(path: Column, generated: Column) -> Column:
    """Generated code and mocks, which change because their source did."""
    return generated | path.rlike(r"(^|/)mocks?/") | path.contains(".gen.") | path.endswith("_gen.go")


#: What each language's extractor takes for a test, and for code of others or built.
TESTS_OF = {
    "ts": r"(\.test\.|\.Spec\.|\.spec\.|\.stories\.)[^/]*$|__tests__/|__mocks__/|(^|/)e2e/|^\.storybook/|/test-utils/|/mocks/|(^|/)setupTests[^/]*$|(^|/)tests?/",
    "java": r"src/test/|src/it/|/testFixtures/|(Test|Tests|IT)\.java$",
    "py": r"(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$|(^|/)tests?/",
    "cs": r"(Tests|Test)\.cs$|(^|/)(tests?|Test|[^/]*Tests|[^/]*\.Test)/",
    "rs": r"(^|/)(tests|benches)/|_tests?\.rs$",
}
OTHERS_OF = {
    "py": r"site-packages/|(^|/)\.?venv/|node_modules/",
    "cs": r"(^|/)(bin|obj|packages|node_modules)/",
    "rs": r"(^|/)(target|vendor)/",
    "ts": r"node_modules/",
}
AUXILIARY = r"\.(sql|proto|ya?ml|tpl|graphql|properties|toml|gradle|kts|csproj|sln|props|targets|go)$"
AUXILIARY_NAMES = ["Dockerfile", "Makefile", "go.mod", "Chart.yaml", "package.json", "pom.xml", "Pipfile", "setup.cfg", "packages.config", "global.json", "nuget.config", "NuGet.config", "rust-toolchain", "CMakeLists.txt", "Gemfile", "Rakefile", "composer.json", "build.sbt", "Podfile"]


def extracted(path: Column, lang: Column) -> Column:
    """Whether an extractor reads a file of its language: no test, nothing of others, nothing built."""
    out = F.lit(True)
    for table in (TESTS_OF, OTHERS_OF):
        for name, pattern in table.items():
            out = out & ~((lang == name) & path.rlike(pattern))
    return out


def auxiliary(path: Column) -> Column:
    """Files without declarations that have a record: schemas, manifests, build files. None of tests or of others."""
    name = basename(path)
    gone = path.endswith("_test.go") | path.contains("testdata/") | (path.rlike(TESTS_OF["ts"]) & ~path.rlike(r"\.spec\.[^/]*$|(^|/)tests?/"))
    for pattern in OTHERS_OF.values():
        gone = gone | path.rlike(pattern)
    return ~gone & (path.rlike(AUXILIARY) | name.isin(AUXILIARY_NAMES) | name.rlike(r"^requirements.*\.txt$"))


def joined(folder: Column, *parts: str | Column) -> Column:
    """A path in a folder; an empty folder is the root."""
    tail = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(folder == "", tail).otherwise(F.concat(folder, F.lit("/"), tail))


def test_candidates(path: Column) -> Column:
    """Where a file's own test usually lives, by its language, the most usual first; none for other languages."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    folder, name = dirname(path), basename(stem)
    add = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.array().cast("array<string>")
    has_main = stem.contains("src/main/")
    tests = F.regexp_replace(stem, r"^(.*)src/main/", "$1src/test/")
    project = F.regexp_replace(stem, "^src/", "")
    first, rest = F.substring_index(project, "/", 1), F.regexp_extract(project, r"^[^/]*/(.*)$", 1)
    dotnet = F.when(project.contains("/"), F.array(*[add(root, first, ".Tests/", rest, "Tests.cs") for root in ("tests/", "test/", "")])).otherwise(none)
    crate = F.when(stem.contains("src/"), F.array(add(F.regexp_extract(stem, r"^(.*)src/", 1), "tests/", name, ".rs"))).otherwise(none)
    ruby = F.regexp_replace(stem, r"^(?:lib/|app/|.*?/lib/|(?!.*/lib/).*?/app/)", "")
    swift = F.regexp_replace(stem, "^Sources/", "")
    module, inner = F.substring_index(swift, "/", 1), F.regexp_extract(swift, r"^[^/]*/(.*)$", 1)
    dart, php = F.regexp_replace(stem, "^lib/", ""), F.regexp_replace(F.regexp_replace(stem, "^src/", ""), "^app/", "")
    return (
        F.when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), F.array(add(stem, ".test", ext), add(stem, ".spec", ext), joined(folder, "__tests__/", name, ".test", ext)))
        .when(ext == ".java", F.when(has_main, F.array(*[add(tests, x) for x in ("Test.java", "Tests.java", "IT.java")])).otherwise(none))
        .when(ext == ".py", F.array(joined(folder, "test_", name, ".py"), joined(folder, name, "_test.py"), joined(folder, "tests/test_", name, ".py"), add("tests/test_", name, ".py")))
        .when(ext == ".cs", F.concat(F.array(add(stem, "Tests.cs"), add(stem, "Test.cs")), dotnet))
        .when(ext == ".rs", F.concat(F.array(add(stem, "_tests.rs"), add(stem, "/tests.rs")), crate))
        .when(ext.isin(".kt", ".scala"), F.when(has_main, F.array(*[add(tests, x, ext) for x in ("Test", "Tests", "Spec", "Suite")])).otherwise(none))
        .when(ext == ".rb", F.array(add("spec/", ruby, "_spec.rb"), add("test/", ruby, "_test.rb"), add(stem, "_spec.rb"), add(stem, "_test.rb")))
        .when((ext == ".swift") & stem.startswith("Sources/") & swift.contains("/"), F.array(*[add("Tests/", module, "Tests/", inner, x) for x in ("Tests.swift", "Test.swift")]))
        .when(ext == ".swift", F.array(add(stem, "Tests.swift")))
        .when(ext == ".dart", F.array(add("test/", dart, "_test.dart"), add("test/", name, "_test.dart"), add(stem, "_test.dart")))
        .when(ext == ".php", F.array(add("tests/", php, "Test.php"), add("tests/Unit/", php, "Test.php"), add(stem, "Test.php")))
        .when(ext.isin(".ps1", ".psm1"), F.array(add(stem, ".Tests.ps1"), joined(folder, "tests/", name, ".Tests.ps1"), add("tests/", name, ".Tests.ps1")))
        .when(ext.isin(".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp"), F.array(add(stem, "_test", ext), add(stem, "_unittest", ext), joined(folder, "test/", name, "_test", ext), add("tests/", name, "_test", ext), add("test/", name, "_test", ext)))
        .otherwise(none)
    )


def test_subject(path: Column) -> Column:
    """The file that a test file tests, by its name; empty for other files."""
    go, script = r"^(.*)_test\.go$", r"^(.*)\.(?:test|spec)(\.[jt]sx?)$"
    return F.when(path.rlike(go), F.regexp_replace(path, go, "$1.go")).when(path.rlike(script), F.regexp_replace(path, script, "$1$2")).otherwise("")
