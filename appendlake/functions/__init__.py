"""Column expressions that table layouts are made of."""

from .keys import char_keys, mono_bucket, padded_number, time_keys

__all__ = ["char_keys", "mono_bucket", "padded_number", "time_keys"]
