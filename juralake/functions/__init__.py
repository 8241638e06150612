"""Column functions: identifiers, text rules, dates, languages."""

from .ids import eli_path, eli_uri, is_valid_ecli, is_valid_eli, is_valid_key_part, normalize_eid, strip_host, work_eli_path
from .text import HIERARCHY_TAGS, LANGUAGES, is_hierarchy_tag, normalize_text, parse_iso_date, parse_language, snippet, strip_ws, tidy, unlinked_ref

__all__ = ["HIERARCHY_TAGS", "LANGUAGES", "eli_path", "eli_uri", "is_hierarchy_tag", "is_valid_ecli", "is_valid_eli", "is_valid_key_part", "normalize_eid", "normalize_text", "parse_iso_date", "parse_language", "snippet", "strip_host", "strip_ws", "tidy", "unlinked_ref", "work_eli_path"]
