import random
import shutil
import subprocess
import zipfile

import pytest

from graphloom.sources import archives, trees

FILES = {
    "pom.xml": "<x/>", "core/pom.xml": "<x/>", "core/src/main/java/A.java": "class A {}", "core/src/test/java/ATest.java": "x", "src/B.java": "class B { String s = \"é\"; }", "core/target/C.java": "x", "src/package-info.java": "", "src/Empty.java": "",
    "src/d.txt": "", "src/Big.java": "x" * 5000, "node_modules/x/E.java": "x",
}


def packed(at, files, top="", link=None):
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(top + name, text)
        if link:
            info = zipfile.ZipInfo(top + link)
            info.external_attr = 0o120777 << 16
            z.writestr(info, "/etc/passwd")
    return str(at)


def rows(df):
    return sorted(map(str, df.select("path", "module", "sha256", "size", "test", "text").collect()))


@pytest.mark.parametrize("top", ["", "project-main/"])
def test_an_archive_gives_the_rows_of_its_tree(spark, tmp_path, top):
    for name, text in FILES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    want = rows(trees.scan(spark, f"file://{tmp_path}/tree", max_bytes=1000))
    assert len(want) == 4
    for at in (packed(tmp_path / "a.zip", FILES, top, link="src/Link.java"), f"file://{tmp_path}/a.zip"):
        for size in (1, 1 << 20):
            assert rows(archives.scan(spark, at, max_bytes=1000, rangeBytes=size)) == want


def test_ranges_are_dealt_to_tasks(spark, tmp_path):
    r = random.Random(1)
    files = {f"d/F{i}.java": "".join(r.choice("abcdefgh\n") for _ in range(r.randint(0, 3000))) for i in range(200)}
    at = packed(tmp_path / "a.zip", files)
    df = archives.entries(spark, at, rangeBytes=10_000)
    assert df.rdd.getNumPartitions() > 20
    assert {r.path: bytes(r.content).decode() for r in df.collect()} == {k[2:]: v for k, v in files.items()}
    more = packed(tmp_path / "b.zip", {"e/G.java": "class G {}"})
    assert archives.entries(spark, at, more).count() == 201


@pytest.mark.parametrize("name", ["../evil.java", "a/../../evil.java", "/etc/evil.java", "..\\evil.java", "C:/evil.java"])
def test_nothing_leads_outside(tmp_path, name):
    with pytest.raises(ValueError, match="leads outside"):
        archives.listed(packed(tmp_path / "a.zip", {"ok.java": "x", name: "x"}))


def test_limits(spark, tmp_path):
    with pytest.raises(ValueError, match="too many"):
        archives.listed(packed(tmp_path / "a.zip", {f"{i}": "" for i in range(11)}), max_entries=10)
    bomb = packed(tmp_path / "b.zip", {"zeros": "0" * 5_000_000})
    with pytest.raises(ValueError, match="too large"):
        archives.listed(bomb, max_unpacked=1_000_000)
    with pytest.raises(Exception, match="too large"):
        archives.entries(spark, bomb, maxUnpacked=1000).collect()
    with zipfile.ZipFile(tmp_path / "e.zip", "w"):
        pass
    with pytest.raises(ValueError, match="empty"):
        archives.listed(str(tmp_path / "e.zip"))
    (tmp_path / "no.zip").write_text("no archive")
    with pytest.raises(ValueError, match="no archive"):
        archives.listed(str(tmp_path / "no.zip"))


def test_sizes_that_lie(spark, tmp_path):
    """The directory says ten bytes: what comes out beyond that raises, or the checksum does."""
    at = tmp_path / "a.zip"
    packed(at, {"F.java": "y" * 3000})
    raw = at.read_bytes()
    at.write_bytes(raw.replace((3000).to_bytes(4, "little"), (10).to_bytes(4, "little")))
    with pytest.raises(Exception, match=r"larger than stated|Bad CRC|CRC"):
        archives.entries(spark, str(at)).collect()


@pytest.mark.skipif(shutil.which("git") is None, reason="no git here")
def test_checkout_of_a_local_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "from"), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "from").mkdir()
    git("init", "-q")
    (tmp_path / "from" / "A.java").write_text("class A {}")
    git("add", ".")
    git("commit", "-qm", "one")
    to = str(tmp_path / "to")
    assert trees.checkout(f"file://{tmp_path}/from", to) == git("rev-parse", "HEAD")
    assert [r.path for r in trees.scan(spark, f"file://{to}").collect()] == ["A.java"]
    (tmp_path / "from" / "B.java").write_text("class B {}")
    git("rm", "-q", "A.java")
    git("add", ".")
    git("commit", "-qm", "two")
    assert trees.checkout(f"file://{tmp_path}/from", to) == git("rev-parse", "HEAD")
    assert [r.path for r in trees.scan(spark, f"file://{to}").collect()] == ["B.java"]
