"""Plan building blocks shared by operators: staged tables, global ranks."""
