from marquee.functions.text import (  # noqa: F401
    clean_title, normalize_title, item_key, year_key, parse_list_strict,
    parse_list_lenient, list_to_text, list_len, slug_year, rating_from_class,
    count_text_to_int, year_prefix_match, year_from_date_text,
)
from marquee.functions.vector import dot, norm, unit, clip, z_to_unit, r6  # noqa: F401
