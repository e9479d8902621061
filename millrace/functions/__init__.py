from .parsing import as_integer, as_number, as_timestamp, order_votes
from .text import EMAIL_PATTERN, is_email, number_text, strip
from .values import distinct_key, is_missing, pearson, percent, present

__all__ = [
    "EMAIL_PATTERN", "as_integer", "as_number", "as_timestamp", "distinct_key", "is_email",
    "is_missing", "number_text", "order_votes", "pearson", "percent", "present", "strip",
]
