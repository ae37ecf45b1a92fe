"""Operations on sequences: DataFrames whose column `_idx` numbers the rows."""

from .bykey import exclusive_scan_by_key, exclusive_scan_by_key_with, inclusive_scan_by_key, reduce_by_key, reduce_by_key_with, scan_by_key_with, unique_by_key
from .indexed import gather, gather_where, permute, scatter, scatter_reduce, scatter_reduce_with, scatter_where
from .ordering import merge, merge_by_key, radix_sort_by_key, sort, sort_by_key
from .reduction import adjacent_find, equal, is_sorted, is_sorted_until, lexicographical_compare, max_element, min_element, minmax_element, mismatch, reduce, reduce_with
from .scans import adjacent_difference, exclusive_scan, exclusive_scan_with, inclusive_scan, scan_with, unique
from .search import find_first_of, lower_bound, upper_bound
from .selection import all_of, any_of, copy_where, count_if, find_if, is_partitioned, none_of, partition, remove_where
from .sets import set_difference, set_intersection, set_union
from .transform import copy, fill, flat_map, map_rows, replace_where, reverse, slice_rows, transform_where, with_table, zip_rows

__all__ = [name for name in dir() if not name.startswith("_")]
