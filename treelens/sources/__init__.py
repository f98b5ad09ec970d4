"""Corpora: file trees and tables."""
