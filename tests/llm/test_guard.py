import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tabsieve").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p


def test_no_local_checkpoints():
    for p in (ROOT / "tabsieve").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text()
