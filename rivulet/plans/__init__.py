"""The fluent API and the registry of named stores."""
