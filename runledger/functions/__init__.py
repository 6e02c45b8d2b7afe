"""Column expressions shared by the operators; no function here touches a DataFrame."""
