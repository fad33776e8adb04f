"""Archives of every kind, built from (name, bytes) members."""

from lumenstrata.sources.build import CODECS, legacy_lz4, tar, zip_

__all__ = ["CODECS", "archives", "legacy_lz4", "tar", "zip_"]


def archives(members) -> dict[str, bytes]:
    t = tar(members)
    return {"tar": t, "zip": zip_(members), **{f"tar.{k}": f(t) for k, f in CODECS.items()}}
