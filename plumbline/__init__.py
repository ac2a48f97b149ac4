"""Plumbline: data-quality profiling, inference and rule execution as Spark DataFrame jobs."""
from plumbline.model import Attachment, Constraints, Entity, Hierarchy, Model
from plumbline.rules import Rule

__all__ = ["Attachment", "Constraints", "Entity", "Hierarchy", "Model", "Rule"]
