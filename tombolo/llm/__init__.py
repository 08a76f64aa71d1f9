"""Training-data operators. Nothing outside this subpackage imports it; each
operator is a module with its own general interface, and ``queries`` holds the
thin ``opN_<name>`` queries that apply them to whole tables."""
