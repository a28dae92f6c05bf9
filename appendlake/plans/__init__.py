"""Table layouts: how keys are derived from columns, and which keys a predicate implies."""
