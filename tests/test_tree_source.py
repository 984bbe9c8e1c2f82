"""Trees with hidden and empty files and archives, read in several tasks; environment files of each tree; the YAML reader; the proximity window."""

import hashlib
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import trees, yaml_text

FILES = {
    ".env": b"MODEL=m-1\n", "pkg/__init__.py": b"", "pkg/.hidden/x.py": b"x = 1\n", "pkg/a b.py": b"import openai\n", "bad.txt": b"a\xff\xfe\xe2\x82b", ".gitignore": b"*.pyc\n", "empty.md": b"",
    "big.py": b"y" * 1_000_001, "edge.py": b"z" * 1_000_000, "deep/1/2/3/4/f.py": b"pass\n", "dist/out.js": b"1\n",
}
SKIPPED = {".git/config": b"x", "node_modules/a.js": b"x", "pkg/__pycache__/a.pyc": b"x", "venv/lib/a.py": b"x"}


def expected(files):
    return {p: (d.decode("utf-8", "replace") if len(d) <= 1_000_000 else "", hashlib.sha256(d).hexdigest(), len(d)) for p, d in files.items()}


def found(rows):
    return {r.path: (r.text, r.content_hash, r.n_bytes) for r in rows.collect()}


def write(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", b"")
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(f"./{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link.py")
        link.type, link.linkname = tarfile.SYMTYPE, "edge.py"
        t.addfile(link)
        away = tarfile.TarInfo("../away.py")
        t.addfile(away, io.BytesIO())
    return out.getvalue()


def test_folder_with_hidden_and_empty_files(spark, tmp_path):
    write(tmp_path, FILES | SKIPPED | {"lib.zip": zipped({"m.py": b"1"})})
    rows = trees.read_tree(spark, str(tmp_path))
    assert found(rows) == expected(FILES | {"lib.zip": (tmp_path / "lib.zip").read_bytes()})
    assert rows.rdd.getNumPartitions() > 3 and {r.tree for r in rows.collect()} == {tmp_path.name}
    assert {(r.ext, r.location) for r in rows.where("path = '.env'").collect()} == {("env", "production")}
    opened = trees.read_tree(spark, f"file://{tmp_path}", archives=True, pieces=2)
    assert found(opened) == expected(FILES | {"lib.zip/m.py": b"1"}) and opened.rdd.getNumPartitions() >= 2
    with pytest.raises(Exception, match="nowhere"):
        trees.read_tree(spark, str(tmp_path / "nowhere")).collect()


@pytest.mark.parametrize("name", ["t.zip", "t.tar", "t.tar.gz", "t.tgz", "t.tar.xz"])
def test_archives_are_trees(spark, tmp_path, name):
    files = FILES | SKIPPED
    (tmp_path / name).write_bytes(zipped(files) if name == "t.zip" else tarred(files, {"t.tar": "w", "t.tar.xz": "w:xz"}.get(name, "w:gz")))
    rows = trees.read_tree(spark, str(tmp_path / name))
    assert found(rows) == expected(FILES) and {r.tree for r in rows.collect()} == {"t"}
    spark.read.format("tree")  # shares of an archive: every task reads its members only
    shared = spark.read.format("tree").options(path=str(tmp_path / name), share_bytes="300").load()
    assert found(shared) == expected(FILES) and shared.count() == len(FILES)
    assert name not in ("t.zip", "t.tar") or shared.rdd.getNumPartitions() > 1


def test_many_trees(spark, tmp_path):
    write(tmp_path, {f"one/{p}": d for p, d in FILES.items()} | {"two.tar.gz": tarred({"a.py": b"2"}, "w:gz"), "three.zip": b"no archive", "note.txt": b"not in a tree"})
    rows = trees.read_tree(spark, str(tmp_path), trees=True).collect()
    assert {(r.tree, r.path) for r in rows} == {("one", p) for p in FILES} | {("two", "a.py"), ("three", "three.zip")}
    (tmp_path / "none").mkdir()
    assert trees.read_tree(spark, str(tmp_path / "none")).count() == 0


# Environment files


def test_environment_of_each_tree(spark):
    shape = "tree string, path string, text string, n_bytes long"
    rows = [("a", "infra/env.example", 'MODEL_DEFAULT="gpt-4o"\nMODEL_FAST=gpt-4o-mini # inline comment\n'), ("a", ".env", "export MODEL_FAST = azure.gpt-4o-mini\r\n#X=1\nEMPTY=\nQ='a # b'\n"), ("a", "src/.env.sample", "KEY=sk-abcdefghijklmnopqrstuv\n"),
            ("a", "app.env", "NO=1\n"), ("a", "dist/.env", "NO=1\n"), ("a", "config/settings.yaml", "environment:\n  MODEL: x\n"), ("a", "docker-compose.yml", "services:\n  worker:\n    environment:\n      MODEL_DEFAULT: gpt-4o\n"),
            ("a", "infra/deploy.yaml", "spec:\n  containers:\n    - name: app\n      env:\n        - name: MODEL_FAST\n          value: gpt-4o-mini\n        - {name: FLAG, value: yes}\n---\nenv: [{name: P, value: 010}]\n"), ("a", "k8s/broken.yml", "environment: [\n")]
    files = spark.createDataFrame([(*r, len(r[2])) for r in rows], shape)
    got = {(r.tree, r.key, r.value, r.path, r.form) for r in trees.environment_defaults(files).collect()}
    assert got == {
        ("a", "MODEL_DEFAULT", "gpt-4o", "infra/env.example", "example"), ("a", "MODEL_FAST", "gpt-4o-mini", "infra/env.example", "example"), ("a", "MODEL_FAST", "azure.gpt-4o-mini", ".env", "pinned"), ("a", "Q", "a # b", ".env", "pinned"),
        ("a", "KEY", "[redacted]", "src/.env.sample", "example"), ("a", "MODEL_DEFAULT", "gpt-4o", "docker-compose.yml", "pinned"), ("a", "MODEL_FAST", "gpt-4o-mini", "infra/deploy.yaml", "pinned"), ("a", "FLAG", "True", "infra/deploy.yaml", "pinned"),
        ("a", "P", "8", "infra/deploy.yaml", "pinned"),
    }


def test_environment_cap_is_per_tree(spark):
    rows = [(t, f"{i:03d}/.env", "A=1", 3 if i else 1 << 20) for t in ("a", "b") for i in range(30)]
    files = spark.createDataFrame(rows, "tree string, path string, text string, n_bytes long")
    got = trees.environment_defaults(files, most_files=10).groupBy("tree").agg(F.count("*").alias("n"), F.max("path").alias("last")).collect()
    assert sorted(map(tuple, got)) == [("a", 9, "009/.env"), ("b", 9, "009/.env")]  # a file too large takes its place


YAML = [
    "a: 1\nb: [x, {y: 2}, 'z']\n", "a: &x {k: v}\nb: *x\nc:\n  <<: *x\n  m: 1\n", "t: |\n  one\n   two\n\n  three\nu: >-\n  a\n  b\n\n  c\nv: |+\n  k\n\nw: end\n", "---\na: 1\n---\nb: yes\n...\n---\n- 1\n- - 2\n  - 3\n-\n  k: v\n",
    "k: \"a\\tb\\u00e9\"\nm: 'it''s'\nn: plain # no\no: x#y\np: http://h:80/z\n", "list:\n- a\n- b: 1\n  c: 2\nnext: ~\n", "a: multi\n  line plain\n  text\nb: 0x1F\nc: 010\nd: 1:30\ne: 1e3\nf: 1.5e+3\ng: 2024-01-02\nh: .5\n",
    "a: b: c\n", "a:\n\tb: 1\n", "{a: 1, b: [1,2,\n 3], c: }\n", 'a: "x\n  y\n\n  z"\n', "# only\n", "", "x:\n  - y:\n      z: 1\n    w: 2\n  - |\n    t\n  - last\n", "a: !!str 12\nb: !foo x\n", "a: - b\n", "a: [1, 2\n",
    "k: >\n  a\n\n    more\n  b\n", "x: &a\n  k: 1\ny: *a\n", "- a\n-b\n", "a: 1\n b: 2\n", "a: '1\n", "on: push\n", "a: {b: c, d: 'e, f'}\nz: [a b, c]\n", "a: *nobody\n", "%YAML 1.1\n---\na: 1\n",
]


@pytest.mark.parametrize("text", YAML)
def test_yaml_as_a_full_reader_says(text):
    yaml = pytest.importorskip("yaml")
    try:
        wanted = list(yaml.safe_load_all(text))
    except yaml.YAMLError:
        with pytest.raises(yaml_text.YamlError):
            yaml_text.documents(text)
    else:
        assert yaml_text.documents(text) == wanted


def test_yaml_environment():
    assert yaml_text.environment("env:\n  - {name: A, value: 1}\n  - {name: B, value: true}\n  - {name: C, valueFrom: x}\n") == [("A", "1"), ("B", "True")]
    assert yaml_text.environment("x: &e\n  environment: {A: 1, 2: b, D: 2024-01-02}\ny: *e\nz:\n  environment:\n  - B=x=y\n  - C\n") == [("A", "1"), ("B", "x=y")]
    assert yaml_text.environment("a: &a\n  b: *a\n") == [] and yaml_text.environment("a: [") == [] and yaml_text.environment("[" * 5000) == []


# Proximity of "model" and "messages"


@pytest.mark.parametrize(("gap", "near"), [(0, True), (289, True), (290, True), (291, False), (400, False)])
@pytest.mark.parametrize("behind", [True, False])
def test_model_near_messages_window(spark, gap, near, behind):
    """The window is 300 characters from where the quoted "model" begins; the other key lies in it whole."""
    body = '"model"' + " " * (gap - 7) + '"messages"' if behind else '"messages"' + " " * gap + '"model"'
    near = near if not behind or gap >= 7 else True
    files = spark.createDataFrame([("a.py", f"requests.post(url)\n{body}\n", "py")], "path string, text string, ext string")
    assert bool(trees.signals(files).where("signal = 'model_near_messages'").count()) == near
