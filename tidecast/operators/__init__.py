"""DataFrame -> DataFrame operators. Every operator handles all entities in one plan."""
