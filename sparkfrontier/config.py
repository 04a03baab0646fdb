"""Settings of the engine, with the defaults of a polite broad crawl; load() overrides them from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    min_gap: float = 5.0
    download_delay: float = 5.1
    max_crawl_delay: float = 60.0
    tolerance: float = 0.05
    shards: int = 2
    crawled_per_domain: int = 5000
    queued_per_domain: int = 500
    max_queues: int = 40_000
    max_frontier: int = 3_000_000
    exempt_factor: float = 1.1
    max_url_length: int = 2048
    max_query_params: int = 5
    max_path_depth: int = 8
    robots_failure_ttl: float = 300.0
    robots_failure_ttl_max: float = 14_400.0
    robots_body_bytes: int = 1_000_000
    min_links: int = 5
    projection_seconds: int = 172_800
    # Extensions and query keys that are never followed.
    skip_extensions: tuple[str, ...] = tuple(
        "jpg jpeg png gif webp svg ico bmp tiff pdf doc docx xls xlsx ppt pptx odt zip gz tar bz2 7z rar xz "
        "mp3 mp4 avi mkv mov wmv flv wav ogg webm css js json xml rss atom exe dmg iso apk deb rpm woff woff2 ttf eot otf".split()
    )
    skip_query_keys: tuple[str, ...] = ("sessionid", "phpsessid", "jsessionid", "sid", "sessid", "session_id")


DEFAULTS = Settings()


def load(path: str | Path) -> Settings:
    """DEFAULTS with what any section of the TOML file sets under the same names."""
    known = {f.name for f in fields(Settings)}
    given: dict = {}
    for section in tomllib.loads(Path(path).read_text(encoding="utf-8")).values():
        if isinstance(section, dict):
            given |= {k: tuple(v) if isinstance(v, list) else v for k, v in section.items() if k in known}
    return replace(DEFAULTS, **given)
