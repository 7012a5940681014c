"""Column functions: geometry measures, predicates, projections, interchange formats, text and time scalars."""
