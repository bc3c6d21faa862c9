import os

import pytest

from tessera.config import DiscoveryConfig
from tessera.errors import DiscoveryError
from tessera.plans.files import Written
from tessera.sources.ignore import Rules, custom_rules, expand_recursive_suffix
from tessera.sources.repository import documents, is_markdown, plan, scan, select_files, skipped


def tree(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return str(root)


def paths(root, **settings):
    return [c.path for c in plan(root, DiscoveryConfig(**settings)) if not c.reason]


def test_sorted_and_ignored(spark, tmp_path):
    root = tree(tmp_path, {".gitignore": "ignored.md\n", "README.md": "a\r\nb\rc", "docs/guide.md": "g", "ignored.md": "x", "src.rs": "x"})
    assert [(r.path, r.text) for r in documents(scan(spark, root)).orderBy("file_ord").collect()] == [("README.md", "a\nb\nc"), ("docs/guide.md", "g")]
    assert paths(root, respect_gitignore=False) == ["README.md", "docs/guide.md", "ignored.md"]


def test_excluded_path_takes_no_slot(tmp_path):
    root = tree(tmp_path, {"a-prompt.md": "p", "b-readme.md": "r"})
    assert [(c.path, c.reason) for c in plan(root, DiscoveryConfig(max_files=1), (f"{root}/a-prompt.md",))] == [("b-readme.md", None)]


def test_limits_come_before_size_and_encoding(spark, tmp_path):
    root = tree(tmp_path, {"a.md": "123456789", "b.md": "12345", "c.md": b"\xff"})
    found = {r.path: (r.reason, r.bytes, r.max_bytes) for r in skipped(scan(spark, root, DiscoveryConfig(max_files=1, max_bytes_per_file=3))).collect()}
    assert found == {"a.md": ("too_large", 9, 3), "b.md": ("file_limit", None, None), "c.md": ("file_limit", None, None)}
    assert {r.path: r.reason for r in skipped(scan(spark, root)).collect()} == {"c.md": "invalid_utf8"}


def test_extra_rules(tmp_path):
    root = tree(tmp_path / "r", {"path/to/module/a.md": "", "path/to/another/test.md": "", "path/to/another/deep/mytest.md": "", "path/to/another/guide.md": "x"})
    rules = tmp_path / "rules"
    rules.write_text("path/to/module/\npath/to/another/**test.md\n")
    assert paths(root, ignore_files=(str(rules),)) == ["path/to/another/guide.md"]
    assert expand_recursive_suffix("a/**b") == "a/**/*b" and expand_recursive_suffix("a/**/b") is None and expand_recursive_suffix("a/**") is None


def test_extra_rules_never_bring_back(tmp_path):
    root = tree(tmp_path / "r", {".gitignore": "x.md\n", "x.md": "", "y.md": ""})
    rules = tmp_path / "rules"
    rules.write_text("!x.md\n")
    assert paths(root, ignore_files=(str(rules),)) == ["y.md"]


def test_order_is_by_components_and_hidden_files_count(tmp_path):
    root = tree(tmp_path, {"a-b.md": "", "a/b.md": "", ".h.md": "", "_x.md": "", ".dir/x.md": "", ".git/x.md": "", ".tessera/x.md": "", "UP.MD": "", ".md": "", "a.markdown": ""})
    assert paths(root) == [".dir/x.md", ".h.md", "UP.MD", "_x.md", "a/b.md", "a-b.md"]
    assert is_markdown("a.Md") and not is_markdown(".md") and not is_markdown("a.mdx")


def test_nested_and_negated_rules(tmp_path):
    root = tree(tmp_path, {".gitignore": "*.md\n!keep.md\n/top/\n", "keep.md": "", "no.md": "", "sub/.gitignore": "!back.md\n", "sub/back.md": "", "sub/no.md": "", "top/keep.md": "", ".git/info/exclude": "sub/keep2.md\n"})
    assert paths(root) == ["keep.md", "sub/back.md"]


@pytest.mark.parametrize("rule, path, directory, said", [("a/b", "a/b", False, True), ("a/b", "x/a/b", False, None), ("b", "x/b", False, True), ("b/", "b", False, None), ("**/z", "z", False, True), ("a/**", "a", True, None), ("a/**", "a/q", False, True), ("a/**/b", "a/b", False, True), ("[!a]x", "bx", False, True), ("\\#x", "#x", False, True), ("# c", "# c", False, None), ("*.md", "a/b.md", False, True), ("a?c", "a/c", False, None)])
def test_rule(rule, path, directory, said):
    assert Rules([rule]).verdict(path, directory) is said


def test_parents_count():
    assert custom_rules(["docs/\n"])[0].ignores_or_a_parent("docs/a.md", False)


def test_missing_root(spark):
    with pytest.raises(DiscoveryError):
        scan(spark, "/no/such/folder")


def test_table_of_files(spark):
    files = spark.createDataFrame([("a/b.md", 9), ("a-b.MD", 1), ("c.txt", 1), ("z.md", 2)], "path string, bytes long")
    settings, keep = DiscoveryConfig(max_files=2, max_bytes_per_file=5), Written(spark)
    found = {r.path: r.reason for r in select_files(files, settings, keep=keep).collect()}
    assert found == {"a/b.md": "too_large", "a-b.MD": None, "z.md": "file_limit"}
    twice = select_files(files.unionByName(files), settings, keep=keep).collect()
    assert sorted(r.file_ord for r in twice) == list(range(6)) and [r.path for r in twice if r.file_ord < 2] == ["a/b.md"] * 2
    assert {r.reason for r in select_files(files, DiscoveryConfig()).collect()} == {None}
    with pytest.raises(DiscoveryError):
        select_files(files, settings)


def test_tasks_list_what_the_driver_lists(spark, tmp_path):
    files = {f"d{k % 5}/e{k % 3}/{k}.md": f"{k}" for k in range(60)} | {".gitignore": "*7.md\n/d4/\n", "d1/.gitignore": "!17.md\ne2/*1.md\n", ".git/info/exclude": "d2/e0/\n", "d3/x.txt": "", "top.md": "t", "d0/deep/er/still/a.md": "x" * 50}
    root = tree(tmp_path / "r", files)
    rules = tmp_path / "rules"
    rules.write_text("d3/**8.md\n")
    for settings in (DiscoveryConfig(), DiscoveryConfig(ignore_files=(str(rules),), max_files=20, max_bytes_per_file=9), DiscoveryConfig(respect_gitignore=False)):
        want = [(c.path, c.ord, c.reason) for c in plan(root, settings, (f"{root}/top.md",))]
        found = scan(spark, root, settings, (f"{root}/top.md",), group_bytes=40).collect()
        assert sorted((r.path, r.file_ord, r.reason) for r in found) == sorted(want) and len(want) > 20
        assert all(r.text == files[r.path] for r in found if r.reason is None)
    (tmp_path / "empty").mkdir()
    assert scan(spark, str(tmp_path / "empty")).count() == 0
