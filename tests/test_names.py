from pathlib import Path


def _module(path: Path) -> str:
    """The name by which pytest imports path: from the lowest folder without __init__.py on."""
    name, folder = path.stem, path.parent
    while (folder / "__init__.py").exists():
        name, folder = f"{folder.name}.{name}", folder.parent
    return name


def test_every_file_of_tests_is_imported_under_a_name_of_its_own():
    names = [_module(p) for p in Path(__file__).parent.rglob("test_*.py")]
    assert len(names) > 1 and sorted(set(names)) == sorted(names)
