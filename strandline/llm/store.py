"""Tables written once to the folder that all executors share, to cut lineage."""

from strandline.sources.stage import discard, new_folder, shared_folder, written

__all__ = ["discard", "new_folder", "shared_folder", "written"]


def free(taken: list[str], name: str) -> str:
    """The name, with as many "_" in front as keep it apart from the taken ones; Spark does not mind case, so neither does this."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name
