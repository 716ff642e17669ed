"""The controller language: text to tokens, trees and facts.  Plain Python, no Spark, except ``columns``."""
