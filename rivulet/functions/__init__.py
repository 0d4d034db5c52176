"""Single-record transforms, predicates, codecs, schema projection and timestamp extraction."""
