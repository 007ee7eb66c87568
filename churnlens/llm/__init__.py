"""Training-data operators over documents and web pages.

Nothing outside this subpackage imports it. ``registry`` holds the queries (one
``opN_<name>`` per operator) and their SQL; every other module is one operator with its own
general interface, except ``text`` (byte-level word kernels) and ``units`` (tokenizer units).
"""
