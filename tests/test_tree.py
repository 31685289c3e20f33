"""The scan of a folder prunes before it lists, and agrees with the scope of a full listing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from harborscan.operators import discovery
from harborscan.sources import tree


def write(root, path, text=""):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.entry, {})[r.path] = r.reason
    return out


FOLDERS = [".uv-cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "node_modules", "dist", "build", "coverage"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tree"))
    for folder in FOLDERS:
        write(top, f"{folder}/nested/noise.py", "x")
    for n in range(40):
        write(top, f".uv-cache/archive-v0/dependency/noise_{n}.py")
    for path in (".coverage", "coverage.xml", ".env", "requirements.txt", "uv.lock", "tests/integration/test_portfolio.py"):
        write(top, path)
    os.symlink(f"{top}/tests", f"{top}/again")
    return top


@pytest.mark.parametrize("splits", [1, 4, 64])
def test_generated_trees_are_not_listed(spark, root, splits):
    got = rows(tree.files_of(spark, root, splits=splits))
    assert set(got["FILE"]) == {".env", "requirements.txt", "uv.lock", "tests/integration/test_portfolio.py"}
    assert set(got["LISTED"]) == {"", "tests", "tests/integration"} and set(got["LINK"]) == {"again"}
    assert set(got["EXCLUDED"]) == {*FOLDERS, ".coverage", "coverage.xml"} and got["EXCLUDED"][".uv-cache"] == "EXCLUDED_DEFAULT_CACHE"


def test_filters_reach_the_walk(spark, root):
    df = tree.files_of(spark, root, splits=1)
    got = rows(df.where(F.col("path").startswith("tests/integration/")))
    assert got == {"FILE": {"tests/integration/test_portfolio.py": None}}
    assert {r.path for r in df.where("entry = 'FILE'").collect()} == {".env", "requirements.txt", "uv.lock", "tests/integration/test_portfolio.py"}
    listed = rows(df.where(F.col("path").startswith("tests") & (F.col("entry") == "LISTED")))
    assert set(listed["LISTED"]) == {"tests", "tests/integration"}
    assert rows(df.where("path = 'tests/integration/test_portfolio.py'")) == {"FILE": {"tests/integration/test_portfolio.py": None}}


def test_includes_reopen_and_ignores_negate(spark, root):
    got = rows(tree.files_of(spark, root, include=["build/nested/"]))
    assert set(got["FILE"]) == {"build/nested/noise.py"} and "build" not in got["EXCLUDED"] and "dist" in got["EXCLUDED"]
    assert {"build", "build/nested"} <= set(got["LISTED"])
    got = rows(tree.files_of(spark, root, gitignore="tests/\n!tests/integration/test_portfolio.py\n*.txt\n"))
    assert set(got["FILE"]) == {".env", "uv.lock", "tests/integration/test_portfolio.py"} and got["EXCLUDED"]["requirements.txt"] == "EXCLUDED_GITIGNORE"
    got = rows(tree.files_of(spark, root, gitignore="tests/\n"))
    assert "tests" not in got["LISTED"] and got["EXCLUDED"]["tests"] == "EXCLUDED_GITIGNORE"
    with pytest.raises(ValueError):
        tree.files_of(spark, root, exclude=["../x"])


def test_agrees_with_the_scope_of_a_full_listing(spark, tmp_path):
    rng, top = random.Random(2), str(tmp_path)
    names = ["src", "build", "Lib", "node_modules", "a b", "keep", "x.test", "é"]
    files = {"/".join([*(rng.choice(names) for _ in range(rng.randint(0, 4))), rng.choice(["m.py", "coverage.xml", "t.tsbuildinfo", "r.md"])]) for _ in range(150)}
    for f in files:
        write(top, f, "abc")
    include, exclude = ["keep/", "src/build/m.py"], ["*.md", "src/Lib/"]
    folders = {"/".join(f.split("/")[:i]) for f in files for i in range(1, f.count("/") + 1)}
    for inc in ([], include):
        full = spark.createDataFrame([(p, p in folders) for p in sorted(files | folders)], "path string, folder boolean")
        why = F.when(F.col("folder"), discovery.scope_of(F.col("path"), inc, exclude, True)).otherwise(discovery.scope_of(F.col("path"), inc, exclude))
        told = {r.path: r for r in full.select("path", "folder", why.alias("why"), discovery.may_hold_included(F.col("path"), inc).alias("inner"), discovery.admits(F.col("path"), inc).alias("ok")).collect()}
        entered = lambda p: told[p].why is None or told[p].inner
        reached = lambda p: all(entered("/".join(p.split("/")[:i])) for i in range(1, p.count("/") + 1))
        seen = {p: r for p, r in told.items() if reached(p)}
        got = rows(tree.files_of(spark, top, inc, exclude, splits=3))
        assert set(got["FILE"]) == {p for p, r in seen.items() if not r.folder and r.why is None and r.ok}
        assert got["EXCLUDED"] == {p: r.why for p, r in seen.items() if r.why and not (r.folder and entered(p))}
        assert set(got["LISTED"]) == {"", *(p for p, r in seen.items() if r.folder and entered(p))}
