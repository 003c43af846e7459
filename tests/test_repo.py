import ast
import pathlib

ROOT = pathlib.Path(__file__).parents[1]


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "quillsieve").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
