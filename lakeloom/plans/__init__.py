"""Models, versions, plans and their application."""
